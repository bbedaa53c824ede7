"""Records of dated roles from the lines of documents: a transducer over sorted lines that looks three lines ahead.

Lines come sorted through the tasks (one shuffle by document); state is carried over batches, so a document
may be as long as it likes. Documents that are rows of lines already (``section_roles``) need neither shuffle nor sort, and the machine
finds their section as it goes. The lines of a batch are marked at once, in Arrow, by what they may hold; only marked ones are searched. A line with a date range starts a role; its title, company and place come from the line's own parts, or from
lines ahead, which are then used up. Other lines become details of the role, joined where they are wrapped.
"""

from __future__ import annotations

import re
import string
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

#: Section headings, by section (fixed values).
HEADINGS = {
    "summary": ("summary", "professional summary", "profile", "objective", "about me", "about", "career objective", "professional profile"),
    "skills": ("skills", "technical skills", "core skills", "key skills", "competencies", "expertise", "technologies", "technical expertise"),
    "experience": ("experience", "work experience", "professional experience", "employment history", "career history", "work history", "professional background", "employment"),
    "education": ("education", "academic background", "academics", "qualifications", "degrees", "academic qualifications", "educational background", "academic credentials"),
    "projects": ("projects", "personal projects", "academic projects", "key projects", "project experience"),
    "certifications": ("certifications", "certificates", "licenses", "accreditations", "professional certifications"),
    "achievements": (
        "achievements", "awards", "honors", "accomplishments", "recognition", "leadership", "leadership  achievements", "leadership and achievements",
        "extracurricular", "activities", "positions of responsibility"),
    "languages": ("languages", "language proficiency", "spoken languages"),
}
#: Date ranges (fixed values).
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_TO = r"(?:[-–—/]|to)"
DATES = rf"(?i)(?:{_MONTH}\s+\d{{4}}\s*{_TO}\s*(?:Present|Current|{_MONTH}\s+\d{{4}}|\d{{4}})|\d{{4}}\s*{_TO}\s*(?:Present|Current|\d{{4}}))"
_DATES, _ONLY_DATES = re.compile(DATES), re.compile(rf"{DATES}\Z")
#: Lines of job boards, marks of list items, and words of titles, firms, places and deeds (fixed values).
_BOARD = re.compile(
    r"(?i)\b(preferred|desired work|willing to relocate|work authorization|employment type|profile source|profile downloaded|total experience|visa sponsorship|"
    r"authorized to work|contract\s*-\s*corp|now or in the future)\b")
_GLYPHS = "-*\u2022\u2023\u25aa\u25ab\u25cf\u25e6\u2043\u2219\uf0a7\uf0b7\u25a0>"
_MARKS = _GLYPHS + string.whitespace + "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_JOBS = r"engineer|developer|analyst|manager|architect|consultant|intern|lead|director|specialist"
_ROLE_WORD = re.compile(rf"(?i)\b({_JOBS})\b")
_LOCAL_ROLE = re.compile(r"(?i)\b(engineer|developer|analyst|manager|architect|lead|consultant|intern)\b")
_EMBEDDED = re.compile(r"(?i)\b(engineer|developer|analyst|manager|architect|consultant|lead|intern|specialist|programmer|freelancer)\b")
_FIRM = re.compile(r"(?i)\b(inc|llc|ltd|corp|technologies|systems|services|group)\b")
_PLACE = re.compile(r"(?:(?i:remote|onsite|on-site|hybrid|wfh|india|usa|u\.s\.a\.?|united states|canada|uk|u\.k\.?)|[A-Z]{2})\Z")
_CITY = re.compile(r"(?i)[A-Za-z][A-Za-z .'-]{0,40},\s*([A-Z]{2}|[A-Za-z][A-Za-z .'-]{1,20})\Z")
_DEED = re.compile(
    "(?i)^(?:Architected|Developed|Designed|Implemented|Built|Led|Created|Improved|Optimized|Deployed|Integrated|Managed|Delivered|Engineered|Collaborated|Mentored|Configured|"
    "Migrated|Reduced|Increased|Automated|Established|Owned|Supported|Analyzed|Processed|Enabled|Wrote|Maintained|Refactored|Troubleshot|Coordinated|Partnered|Worked|"
    "Responsible|Spearheaded|Drove|Executed|Enhanced|Launched|Conducted|Performed|Utilized|Leveraged|Applied|Contributed|Assisted|Presented|Facilitated)\\b")
_TOOLS = re.compile(r"(?i)^environment\s*:")
_GAP = re.compile(r"(?i)\bgap\s*period\b")
_GAP_TAIL = re.compile(r"(?i)\s*gap\s*period\s*[\[(][^\])]*[\])]\s*$")
_EDGES = " ,|(-–—"
_TITLE_DOTS = re.compile(r"(?i)\b(Jr|Sr|Dr|Mr|Mrs|Ms|St|Dept)\.")
_NO_KEY, _NO_WORD = re.compile("[^a-z0-9 ]+"), re.compile("[^a-z0-9]+")
_FIRM_KIND = re.compile(r"\b(inc|llc|ltd|corp|co|limited|technologies|technology|pvt|private)\b\.?")
_LONG_MONTH = re.compile(r"(jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|tember|ober|ember)")
_JAMS = ((re.compile(r"(?i)\b(AI/?ML)(Developer|Engineer|Architect|Specialist)\b"), r"\1 \2"), (re.compile(r"(?i)\b(Master|Bachelor|Institute|College|University)(of)\b"), r"\1 \2"))
#: Lines that a role may look ahead.
AHEAD = 3


def clean(text: str) -> str:
    text = " ".join(text.split())
    low = text.lower()
    if "of" in low or "ml" in low or not text.isascii():
        for jam, parted in _JAMS:
            text = jam.sub(parted, text)
    return text


def is_bullet(line: str) -> bool:
    return line != "" and line[0] in _GLYPHS


def detail(line: str) -> str:
    return " ".join(line.lstrip(_MARKS).split())


def heading_key(line: str) -> str:
    return _NO_KEY.sub("", line.lower()).strip()


def _known(key: str) -> bool:
    if key in _ALL:
        return True
    if key.split(" ", 1)[0] not in _FIRST_WORDS or len(key.split()) > 6:
        return False
    rests = (key[len(h) :].strip() for h in _ALL if key.startswith(f"{h} "))
    return any(len(r.split()) <= 3 and len(r) <= 40 for r in rests)


_ALL = frozenset(h for names in HEADINGS.values() for h in names)
_FIRST_WORDS = frozenset(h.split()[0] for h in _ALL)


def is_place(text: str) -> bool:
    return not text or bool(_PLACE.match(text)) or bool(_CITY.match(text) and not _LOCAL_ROLE.search(text))


def no_title(text: str) -> bool:
    """Whether a line is a place, a sentence or the end of one rather than a title."""
    text = text.strip()
    if is_place(text) or len(text) > 110 or text[:1].islower():
        return True
    bare, n = _TITLE_DOTS.sub(r"\1", text) if "." in text else text, len(text.split())
    ends = bare.endswith(".") and n >= 2 and (n >= 6 or not _ROLE_WORD.search(text))
    return ". " in bare or ends or n >= 14 or (n >= 8 and bool(_DEED.match(text)))


def is_gap(company: str, title: str = "") -> bool:
    return bool(_GAP.search(f"{company} {title}"))


def _wraps(line: str) -> bool:
    """Whether a line before a dated one is the tail of the item above."""
    n = len(line.split())
    return bool(line) and not is_bullet(line) and not _DATES.search(line) and (line[:1].islower() or (no_title(line) and n <= 12))


def _opens(text: str, items: list[str]) -> bool:
    """Whether a line without a mark is an item of its own."""
    if not items:
        return True
    before, high = items[-1].rstrip(), text[:1].isupper()
    return high and before.endswith((".", ";", ":")) or (bool(_DEED.match(text)) and len(before) >= 60) or (high and len(text.split()) >= 8 and len(before) >= 80)


def _parts(text: str, mark: str) -> list[str]:
    return [p.strip() for p in text.split(mark) if p.strip()]


def _split_place(company: str) -> tuple[str, str]:
    """(company, place): up to two short trailing parts that name no firm are the place."""
    bits, place = _parts(company, ","), []
    while len(bits) > 1 and len(place) < 2 and len(bits[-1].split()) <= 3 and len(bits[-1]) <= 40 and not _FIRM.search(bits[-1]):
        place.insert(0, bits.pop())
    return (", ".join(bits), ", ".join(place)) if place else (company, "")


@dataclass
class Role:
    title: str = ""
    company: str = ""
    location: str = ""
    duration: str = ""
    technologies: list[str] = field(default_factory=list)
    items: list[str] = field(default_factory=list)

    def tools(self, payload: str) -> None:
        for t in (x.strip() for x in re.split("[,;|]+", payload)):
            if t and len(t) <= 80 and len(t.split()) <= 8 and t.casefold() not in map(str.casefold, self.technologies):
                self.technologies.append(t)

    def key(self) -> str:
        """Roles of one firm and time are one; '' if the firm is unknown."""
        firm = _NO_WORD.sub("", _FIRM_KIND.sub("", self.company.lower()))
        time = re.sub(r"\s+to\s+", " ", re.sub("[–—-]", " ", self.duration.lower()))
        time = _LONG_MONTH.sub(r"\1", time)
        return f"{firm}|{_NO_WORD.sub('', time)}" if firm else ""


def header(line: str, date: re.Match) -> Role:
    """A role from a dated line: company, place (dates) | title; title | company dates; title at company dates."""
    before, after = line[: date.start()].strip(_EDGES), line[date.end() :].strip(" ,|)-–—")
    title, company = "", before
    if "|" in before:
        parts = _parts(before, "|")
        if len(parts) >= 2 and not no_title(parts[0]) and len(parts[0]) <= 90:
            title, company = parts[0], " | ".join(parts[1:])
    if "|" in after:
        parts = _parts(after, "|")
        title = parts[0] if parts and not no_title(parts[0]) else title
    elif after and not _ONLY_DATES.match(after) and not no_title(after):
        title = after
    if not title and " at " in before.lower():
        left, right = re.split(r"(?i)\s+at\s+", before, maxsplit=1)
        if not no_title(left):
            title, company = left.strip(), right.strip()
    company, place = _split_place(company)
    return Role(clean(title), clean(company), clean(place), clean(date[0].strip()))


class Builder:
    """The machine of one document: ``feed`` lines in order, then ``close``; ``roles`` are what it has found.

    A line comes with what ``marks`` says of it: whether it may hold dates, and whether it may be a heading or one of the other
    lines that are known by their words. Without marks it may be anything.
    """

    def __init__(self) -> None:
        self.roles: list[Role] = []
        self.role: Role | None = None
        self.wait: deque[tuple[str, bool, bool]] = deque()

    def feed(self, line: str, dated: bool = True, special: bool = True) -> None:
        self.wait.append((line.strip(), dated, special))
        if len(self.wait) > AHEAD:
            self._step()

    def close(self) -> list[tuple]:
        while self.wait:
            self._step()
        self._save()
        found = map(_promoted, _richest(self.roles))
        return [(r.title, r.company, r.location, r.duration, r.technologies, r.items) for r in found]

    def _save(self) -> None:
        role, self.role = self.role, None
        if role is None or not (role.company or role.title):
            return
        tools = [x for x in role.items if x[:1] in ("e", "E") and _TOOLS.match(x)]
        for text in tools:
            role.tools(text.split(":", 1)[1].strip())
        role.items = [x for x in role.items if x and x not in tools]
        if _TOOLS.match(role.title):
            role.title = ""
        if not is_gap(role.company, role.title):
            self.roles.append(role)

    def _step(self) -> None:
        line, dated, special = self.wait.popleft()
        if not line:
            return
        if special:
            if _known(heading_key(line)) or _BOARD.search(line):
                return
            line = _GAP_TAIL.sub("", line).strip()
            if not line or is_gap(line):
                return
        date, bullet = _DATES.search(line) if dated else None, line[0] in _GLYPHS
        if bullet or not date:
            following, soon, _ = self.wait[0] if self.wait else ("", False, False)
            ahead = _DATES.search(following) if soon and not bullet and following and not is_bullet(following) else None
            if ahead:
                self._before_dates(line, following, ahead)
            elif self.role is not None:
                self._detail(line, bullet, dated, special)
        else:
            self._dated(line, date)

    def _dated(self, line: str, date: re.Match) -> None:
        self._save()
        role = header(line, date)
        if is_gap(role.company, role.title):
            return
        if not role.title:
            self._look_ahead(role)
        self.role = role

    def _look_ahead(self, role: Role) -> None:
        """A title, and a place before it, from the next lines; what is taken is blanked."""
        taken = "", False, False
        for i, (text, dated, special) in enumerate(list(self.wait)[:AHEAD]):
            if not text:
                continue
            if is_bullet(text) or (dated and _DATES.search(text)):
                return
            if is_place(text):
                role.location = role.location or clean(text)
                self.wait[i] = taken
            elif not ((special and (_known(heading_key(text)) or _TOOLS.match(text) or is_gap(text))) or no_title(text)) and len(text) < 120:
                role.title = clean(text)
                self.wait[i] = taken
                return
            elif len(text.split()) > 3 or len(text) > 40:
                return

    def _before_dates(self, line: str, following: str, date: re.Match) -> None:
        """A line whose next line is dated: the tail of an item, or the title of a role whose company stands with the dates."""
        if _TOOLS.match(line) or is_gap(line):
            return
        if self.role is not None and _wraps(line):
            tail = detail(line)
            if tail and self.role.items:
                self.role.items[-1] = f"{self.role.items[-1]} {tail}"
            elif tail:
                self.role.items.append(tail)
            return
        self._save()
        self.wait.popleft()
        before = following[: date.start()].strip(_EDGES)
        bad = no_title(line)
        title, company, place = "" if bad else line, before or following, ""
        parts = _parts(before, "|")
        if len(parts) >= 2 and not title and not no_title(parts[0]):
            title, company = parts[0], " | ".join(parts[1:])
        bits = _parts(company, ",")
        if len(bits) >= 2 and len(bits[-1].split()) <= 3:
            company, place = ", ".join(bits[:-1]), bits[-1]
        self.role = Role(clean(title), clean(company), clean(place), clean(date[0].strip()))
        if bad and detail(line):
            self.role.items.append(detail(line))

    def _detail(self, line: str, bullet: bool, dated: bool, special: bool) -> None:
        role = self.role
        if special and heading_key(line).startswith("environment"):
            role.tools(line.split(":", 1)[1].strip() if ":" in line else "")
            return
        text = detail(line)
        if not text or (dated and _DATES.search(text)):
            return
        joins = not bullet and role.items and (not text[:1].isupper() or (not _opens(text, role.items) and len(text.split()) < 8 and not text.endswith(".")))
        if joins:
            role.items[-1] = f"{role.items[-1]} {text}"
        else:
            role.items.append(text)


def _richest(roles: list[Role]) -> list[Role]:
    """One role a firm and time, at the first's place: the one with most items; titles are handed on."""
    out: list[Role] = []
    at: dict[str, int] = {}
    for role in roles:
        k = role.key()
        if not k or k not in at:
            if k:
                at[k] = len(out)
            out.append(role)
            continue
        kept = out[at[k]]
        if len(role.items) > len(kept.items):
            role.title = role.title or kept.title
            out[at[k]] = role
        elif not kept.title:
            kept.title = role.title
    return out


def _promoted(role: Role) -> Role:
    """A missing title from the first item, if that looks like one; a place in its stead becomes the place."""
    if role.title and is_place(role.title):
        role.location, role.title = role.location or role.title, ""
    if role.title or not role.items:
        return role
    left, _, right = (p.strip() for p in role.items[0].partition("|"))
    named = bool(_EMBEDDED.search(left)) or ("|" in role.items[0] and len(left) <= 60)
    if no_title(left) or not 1 <= len(left.split()) <= 10 or _DEED.match(left) or not named:
        return role
    role.title = clean(left)
    role.items = ([right] if len(right) > 24 and not _TOOLS.match(right) else []) + role.items[1:]
    return role


class Section:
    """The machine of one whole document: its lines between the section's first heading and the next other heading go to a builder; if
    those hold no dates, all lines do. Lines are held only until a dated one of the section comes."""

    def __init__(self, section: str) -> None:
        self.section, self.builder, self.rest = section, Builder(), []
        self.inside, self.over, self.dated = False, False, False

    def feed(self, line: str | None, dated: bool = True, special: bool = True) -> None:
        if not self.dated:
            self.rest.append((line or "", dated, special))
        if self.over or line is None:
            return
        if special and is_heading(line):
            own = is_heading(line, self.section)
            if own or self.inside:
                self.inside, self.over = own, not own
                return
        if self.inside:
            if not self.dated and dated and _PLAIN_DATES.search(line):
                self.dated, self.rest = True, []
            self.builder.feed(line, dated, special)

    def close(self) -> list[tuple]:
        if not self.dated:
            self.builder = Builder()
            for x in self.rest:
                self.builder.feed(*x)
        return self.builder.close()


def is_heading(line: str, section: str | None = None) -> bool:
    """What ``heading_of`` says of one line."""
    key = _NO_KEY.sub("", line.lower()).strip(" ")
    names, longer = _NAMES[section]
    return key in names or (len(key) <= 80 and len(re.split(" +", key)) <= 6 and longer.match(key) is not None)


def _longer(names: tuple[str, ...]) -> str:
    """Pattern of a known name with up to three more words."""
    return rf"^(?:{'|'.join(sorted(names, key=lambda h: (-len(h), h)))}) +[^ ]+(?: +[^ ]+){{0,2}}$"


_NAMES = {k: (frozenset(v), re.compile(_longer(v))) for k, v in [(None, tuple(_ALL)), *HEADINGS.items()]}
#: Dates as Spark's patterns see them.
_PLAIN_DATES = re.compile(DATES, re.ASCII)
# Patterns over lower-cased lines that leave out no line with dates, or of a heading, job board, gap or environment. Characters that a
# heading's key leaves out may stand between its letters.
_MAY_DATE = r"[0-9]{4}[^a-z0-9]*(?:to|[-–—/])"
_MAY_BE_SPECIAL = (
    rf"^[^a-z0-9]*(?:{'|'.join('[^a-z0-9 ]*'.join(w) for w in sorted(_FIRST_WORDS | {'environment'}))})|gap[^a-z0-9]*period|contract[^a-z0-9]*corp|preferred|desired work|willing to relocate|"
    r"work authorization|employment type|profile source|profile downloaded|total experience|visa sponsorship|authorized to work|now or in the future")
#: Lines with other characters than ASCII, marks of items, dashes and quotation marks (none of them a letter, digit or space) may be anything.
_NOT_PLAIN = rf"[^\x00-\x7F{_GLYPHS[2:-1]}–—‘’“”…]"


def marks(lines: pa.Array) -> tuple[list[bool], list[bool]]:
    """(dated, special) of each line: whether it may hold dates, and whether it may be a line that is known by its words."""
    low, odd = pc.ascii_lower(lines), pc.match_substring_regex(lines, _NOT_PLAIN)
    may = (pc.fill_null(pc.or_(odd, pc.match_substring_regex(low, p)), True) for p in (_MAY_DATE, _MAY_BE_SPECIAL))
    return tuple(np.asarray(m).tolist() for m in may)


# ---------------------------------------------------------------- DataFrames


def heading_of(line: Column, section: str | None = None) -> Column:
    """Whether a line is a heading of the section, or of any: a known name, or one with up to three more words."""
    names = HEADINGS[section] if section else tuple(sorted(_ALL))
    k = F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9 ]+", ""))
    longer = k.rlike(_longer(names)) & (F.size(F.split(k, " +")) <= 6) & (F.length(k) <= 80)
    return (k != "") & (k.isin(*names) | longer)


def section_of(rows: DataFrame, section: str, dated: bool = True) -> DataFrame:
    """Lines (doc_id, ln, line) between the section's first heading and the next other heading; dated: and all lines of documents where those hold no dates."""
    doc = W.partitionBy("doc_id")
    marked = rows.withColumn("_t", heading_of(F.col("line"), section)).withColumn("_k", heading_of(F.col("line")))
    marked = marked.withColumn("_from", F.min(F.when(F.col("_t"), F.col("ln"))).over(doc))
    marked = marked.withColumn("_to", F.min(F.when(F.col("_k") & ~F.col("_t") & (F.col("ln") > F.col("_from")), F.col("ln"))).over(doc))
    inside = F.coalesce((F.col("ln") > F.col("_from")) & (F.col("_to").isNull() | (F.col("ln") < F.col("_to"))) & ~F.col("_t"), F.lit(False))
    if not dated:
        return marked.where(inside).select("doc_id", "ln", "line")
    marked = marked.withColumn("_in", inside).withColumn("_dated", F.max(F.col("_in") & F.col("line").rlike(DATES)).over(doc))
    return marked.where("_in or not _dated").select("doc_id", "ln", "line")


def _emitter(columns: str) -> tuple[str, Callable[[list[tuple]], pa.RecordBatch]]:
    """(schema, rows to a batch) of records with a doc_id and a number."""
    schema = f"doc_id long, rec long, {columns}"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), kinds, strict=True)], names=kinds.names)

    return schema, out


def transduce(rows: DataFrame, machine: Callable[[], object], columns: str) -> DataFrame:
    """doc_id, rec (from 1) and the columns of the records that a machine finds in each document of lines(doc_id, ln, line).

    One shuffle by document and a sort; then lines stream through, blank ones included, and the machine of the document at hand is all that is held.
    A machine has ``feed(line)`` and ``close()``, which gives its records' columns.
    """
    schema, out = _emitter(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        closed = lambda: [(at, i, *r) for i, r in enumerate(now.close(), 1)] if now else []
        for batch in batches:
            done: list[tuple] = []
            for doc, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is None or doc != at:
                    done += closed()
                    at, now = doc, machine()
                now.feed(line or "")
            if done:
                yield out(done)
        if done := closed():
            yield out(done)

    ordered = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ln", "line").repartition("doc_id").sortWithinPartitions("doc_id", "ln").select("doc_id", "line")
    return ordered.mapInArrow(run, schema)


_ROLE = "title string, company string, location string, duration string, technologies array<string>, items array<string>"


def roles(rows: DataFrame) -> DataFrame:
    """doc_id, rec, title, company, location, duration, technologies, items of the roles in lines(doc_id, ln, line), blank lines included."""
    return transduce(rows, Builder, _ROLE)


def section_roles(docs: DataFrame, section: str = "experience") -> DataFrame:
    """What ``roles`` finds in the lines that ``section_of`` leaves of docs(doc_id, lines array<string>): a document is a row, so nothing
    is shuffled or sorted, and lines are marked a batch at a time."""
    schema, out = _emitter(_ROLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lists = batch.column(0).to_pylist(), batch.column(1)
            lines, ends = lists.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0)).tolist()
            texts, (dated, special) = lines.to_numpy(zero_copy_only=False).tolist(), marks(lines)
            done: list[tuple] = []
            for doc, a, b in zip(docs, [0, *ends], ends, strict=False):
                now = Section(section)
                for x in zip(texts[a:b], dated[a:b], special[a:b], strict=True):
                    now.feed(*x)
                done += [(doc, i, *r) for i, r in enumerate(now.close(), 1)]
            if done:
                yield out(done)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lines").mapInArrow(run, schema)
