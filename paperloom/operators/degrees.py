"""Records of education and of projects, on the transducer of the roles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import roles as R

#: Words that make a line one of a degree, and names of schools (fixed values).
DEGREES = (
    "bachelor", "master", "phd", "doctorate", "mba", "bs", "ba", "ms", "ma", "b.tech", "b.e.", "m.tech", "m.e.", "b.sc", "m.sc", "b.com", "m.com", "bca", "mca", "bba", "bdes", "mdes",
    "associate", "diploma", "certificate", "high school", "12th", "10th", "ssc", "hsc", "cbse", "icse", "b.e", "m.e",
)
_NAME, _NOTE = r"[A-Za-z][A-Za-z.&'\-]+", r"(?:\s*\([^)]{1,48}\))?"
_KINDS = "University|College|Institute|School|Academy|IIT|NIT|IIIT|IIM|BITS"
_SCHOOL = re.compile(rf"((?:{_NAME}\s+){{0,8}}(?:{_KINDS}){_NOTE}(?:\s+of\s+{_NAME}{_NOTE}(?:\s+{_NAME}){{0,6}})?{_NOTE}(?:\s+(?:at\s+)?{_NAME}){{0,4}})")
_SCHOOL_WORD = re.compile(rf"(?i)\b({_KINDS})\b")
_AT = re.compile(r"(?i)\b((?:bachelor|master|masters|phd|mba|b\.?tech|m\.?tech|bachelors|ms|bs|ba|ma)[^@]{0,60}?)\s*@\s*(.+)$")
#: A number behind "No" or "#" is no year.
_YEAR = re.compile(r"(?<!\b[Nn][Oo] )(?<!\b[Nn][Oo]\. )(?<!#)\b(19\d{2}|20\d{2})\b")
_GRADE = re.compile(r"(?i)(?:cgpa|gpa|percentage)[\s:]*([\d.]+(?:\s*/\s*\d+)?)")
_GLUED = ((re.compile(r"(?i)\b(University|College|Institute|School|Academy|Masters?|Bachelors?)of\b"), r"\1 of"), (re.compile(r"(?i)\b(Technology|Engineering|Management|Science|Studies)\("), r"\1 ("))
_BROKEN = ((re.compile(r"(?i)\btech\s+nology\b"), "Technology"), (re.compile(r"(?i)\bengi\s+neering\b"), "Engineering"))
_CAMPUS = re.compile(r"(?i)\b(springfield|amravati|kharagpur|delhi)\b")
_CRUMBS = re.compile(r"(?i)\b(springfield|delhi|india|il|tx|pa|nj|ks|va)\b")


def _squeeze(text: str, edges: str) -> str:
    return re.sub(r"\s+", " ", text).strip(edges)


def degree_line(line: str) -> tuple[str, str, str, str] | None:
    """(degree, school, year, grade) of a line that names a degree; None if no more than crumbs are left of it."""
    date, year, grade, school = R._DATES.search(line), _YEAR.search(line), _GRADE.search(line), _SCHOOL.search(line)
    when = date[0].strip() if date else year[1] if year else ""
    mark, place = grade[1].strip() if grade else "", school[1] if school else ""
    name = line
    for part in (place, when):
        name = name.replace(part, "").strip() if part else name
    if mark:
        name = re.sub(rf"(?i)(?:cgpa|gpa|percentage)[\s:]*{re.escape(mark)}", "", name).strip()
    name = _squeeze(re.sub("[|,;]", " ", name).strip(), " :-")
    for broken, whole in _BROKEN:
        name = broken.sub(whole, name)
    campus = _CAMPUS.search(name)
    if campus and place and campus[1].lower() not in place.lower():
        city = campus[1].title()
        if "illinois" in place.lower() and city == "Springfield":
            place += " at Springfield"
        elif city != "Delhi":
            place += f", {city}"
    name = _squeeze(_CRUMBS.sub("", name).strip(" ,"), " ,-")
    return (name, place, when, mark) if len(name) > 3 else None


class Education:
    """A degree word starts a record; the lines behind it give school, year and grade, where missing, and details."""

    def __init__(self) -> None:
        self.found: list[list] = []
        self.open: list | None = None

    def feed(self, line: str) -> None:
        line = line.strip()
        for glued, apart in _GLUED:
            line = glued.sub(apart, line)
        if not line or R._BOARD.search(line):
            return
        at = _AT.search(line)
        if at:
            year = _YEAR.search(line)
            self.found.append([R.clean(_squeeze(at[1], " :-")), R.clean(_squeeze(at[2], " :-")), year[1] if year else "", "", []])
            self.open = None
            return
        degree = any(w in line.lower() for w in DEGREES)
        if not degree and R._DATES.search(line) and ("|" in line or "," in line):
            return
        if degree:
            got = degree_line(line)
            # a line of crumbs ends the record before it and starts none
            self.open = [*got, []] if got else None
            if got:
                self.found.append(self.open)
        elif self.open is not None:
            self._detail(line, self.open)

    def _detail(self, line: str, record: list) -> None:
        year, grade = _YEAR.search(line), _GRADE.search(line)
        if not record[1] and _SCHOOL_WORD.search(line):
            record[1] = R.clean(line)
        elif not record[2] and year:
            record[2] = year[1]
        elif not record[3] and grade:
            record[3] = grade[1].strip()
        else:
            text = re.sub("^[\\-*•\\s>]+", "", line).strip()
            if text and len(text) < 160:
                record[4].append(text)

    def close(self) -> list[tuple]:
        seen, out = set(), []
        for r in self.found:
            key = (r[1].lower(), r[0].lower()[:48])
            if key not in seen:
                seen.add(key)
                out.append(tuple(r))
        return out


_SEAM = re.compile(r"(?<=[.!?])\s+(?=[A-Z][A-Za-z0-9].{0,40}[–—\-])")
_CAMEL = re.compile(r"^[A-Z][A-Za-z0-9]+(?:[A-Z][a-z0-9]+)+")


def is_project_title(text: str) -> bool:
    if not text or R.is_bullet(text):
        return False
    n = len(text.split())
    short = n <= 10 and not text.endswith(".") and text[:1].isupper() and ". " not in text and len(text) <= 100
    return short or (n <= 14 and bool(re.search(r"[–—\-]\s*[A-Z]", text))) or (len(text) <= 90 and bool(_CAMEL.match(text)))


class Projects:
    """A title-like line behind a description starts a record, a blank line closes it; names in parentheses are technologies."""

    def __init__(self) -> None:
        self.found: list[tuple] = []
        self.name, self.tools, self.items = None, [], []

    def _save(self) -> None:
        if self.name:
            self.found.append((self.name, self.tools, self.items))
        self.name, self.tools, self.items = None, [], []

    def feed(self, line: str) -> None:
        line = line.strip()
        text, bullet = R.detail(line), R.is_bullet(line)
        if not line:
            self._save()
        if not text:
            return
        seam = _SEAM.search(text) if self.name is not None and not bullet else None
        if seam:  # the end of a description and the next title on one line
            self.items.append(text[: seam.start()].strip())
            self._save()
            text = text[seam.start() :].strip()
        if self.name is not None and self.items and not bullet and is_project_title(text):
            self._save()
        if self.name is None:
            tools = re.search(r"\(([^)]+)\)", text)
            if tools:
                self.tools = [t.strip() for t in tools[1].split(",") if t.strip()]
                text = text.replace(tools[0], "").strip()
            self.name = re.split(r"(?<=[.!?])\s+", text)[0].strip()
        elif bullet or not self.items:
            self.items.append(text)
        else:
            self.items[-1] = f"{self.items[-1]} {text}"

    def close(self) -> list[tuple]:
        self._save()
        return self.found


def projects(rows: DataFrame) -> DataFrame:
    """doc_id, rec, name, technologies, items of the projects sections of lines(doc_id, ln, line), blank lines included."""
    return R.transduce(R.section_of(rows, "projects", dated=False), Projects, "name string, technologies array<string>, items array<string>")


def _degree_words(line: Column) -> Column:
    low, has = F.lower(line), lambda *w: F.greatest(*[F.contains(F.lower(line), F.lit(x)) for x in w])
    school = has("university", "college", "institute")
    return (F.contains(low, F.lit("@")) & has("bachelor", "master", "phd", "mba", "b.tech", "m.tech")) | (~F.contains(low, F.lit("@")) | ~has("bachelor", "master", "phd", "mba", "b.tech", "m.tech")) & has("bachelor", "master of", "b.tech", "m.tech", "masters") & school


def education(rows: DataFrame) -> DataFrame:
    """doc_id, rec, degree, institution, year, grade, details from all education sections of lines(doc_id, ln, line), and then from
    lines anywhere that name a degree with a school or an @."""
    upto = W.partitionBy("doc_id").orderBy("ln").rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("_t", R.heading_of(F.col("line"), "education")).withColumn("_k", R.heading_of(F.col("line")))
    marked = marked.withColumn("_last", F.last(F.when(F.col("_k"), F.col("_t")), ignorenulls=True).over(upto))
    inside = marked.where("_last and not _t").select("doc_id", F.struct(F.lit(0).alias("part"), "ln").alias("ln"), "line")
    other = rows.where(_degree_words(F.col("line"))).select("doc_id", F.struct(F.lit(1).alias("part"), "ln").alias("ln"), "line")
    return R.transduce(inside.unionByName(other), Education, "degree string, institution string, year string, grade string, details array<string>")
