"""Scalar text functions as column expressions.

Patterns avoid look-around, so an RE2 engine reads them alike. White space is
the ASCII class; letters outside ASCII drop out of keys (``alnum_key``) unless
``unicode=True``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: Phone shapes in order of preference: international, grouped, plain run.
PHONES = (r"\+[0-9][0-9 ().-]{7,}[0-9]", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"[0-9]{10,15}")
URL = r"https?://[^\s<>\"]+"
YEAR = r"(?:19|20)[0-9]{2}"


def alnum_key(c: Column, unicode: bool = False) -> Column:
    """Lower-cased letters and digits only: the key under which texts count as equal."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+" if unicode else "[^a-z0-9]+", "")


def part_of(share: float, n: Column) -> Column:
    """A share of a whole number, exact: in double precision 0.55 * 100 is more than 55, and so fails what reaches 55."""
    return F.lit(Decimal(str(share))) * n.cast("long")


def squash(c: Column) -> Column:
    """White-space runs become one space, none at the ends; bullet glyphs at the start go."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[\s•*·-]+", ""), r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_truthy(*columns: Column) -> Column:
    """First column that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def first_nonempty(*arrays: Column) -> Column:
    """First array that is neither null nor empty."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])


def words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, r"\s+", " "), " "), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def title_case(c: Column, small: Sequence[str] = ("of", "and", "the", "in", "for", "to", "a")) -> Column:
    """Words with capital initials; small words stay low but at the start, two- to four-letter capitals stay capitals."""
    plain = F.regexp_replace(F.regexp_replace(c, "_", " "), r"[:：\s]+$", "")

    def one(w: Column, i: Column) -> Column:
        lower = F.lower(w)
        return (
            F.when(w.rlike("^[A-Z]{2,4}$"), w)
            .when((i > 0) & lower.isin(*small), lower)
            .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(lower, 2, 1_000_000)))
        )

    return F.array_join(F.transform(F.split(plain, " "), one), " ")


def hex_color(c: Column, default: str = "#000000") -> Column:
    """#RGB and #RRGGBB, with or without #, as upper-case #RRGGBB; anything else is the default."""
    bare = F.upper(F.regexp_replace(F.trim(c), "^#", ""))
    return F.when(bare.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("#"), bare)).when(
        bare.rlike("^[0-9A-F]{3}$"), F.concat(F.lit("#"), F.regexp_replace(bare, "([0-9A-F])", "$1$1"))
    ).otherwise(default)


def rgb(color: Column) -> Column:
    """Red, green, blue of a #RRGGBB color."""
    return F.struct(*[F.conv(F.substring(color, at, 2), 16, 10).cast("long").alias(n) for n, at in (("r", 2), ("g", 4), ("b", 6))])


def to_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def first_match(c: Column, patterns: Sequence[str]) -> Column:
    """Match of the first pattern that matches at all; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in patterns])


def phone(c: Column) -> Column:
    return first_match(c, PHONES)


def best_email(c: Column) -> Column:
    """The longest address whose local part has five characters, else the longest; the first of equals."""
    found = F.regexp_extract_all(c, F.lit(f"({EMAIL})"), F.lit(1))
    ranked = F.transform(
        found, lambda e, i: F.struct((F.instr(e, "@") > 5).cast("int").alias("long_local"), F.length(e).alias("n"), (-i).alias("p"), e.alias("e"))
    )
    return F.array_max(ranked)["e"]


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^https?://([^/?#:]+)", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^https?://[^/?#]+(/[^?#]*)", 1)


def url_tld(c: Column) -> Column:
    return F.regexp_extract(url_host(c), r"\.([a-z]+)$", 1)


def object_key(c: Column) -> Column:
    """Storage key: backslashes become slashes, leading slashes go, other marks become _."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "^/+", ""), r"[^a-zA-Z0-9._/-]", "_")


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9._-]", "_")


def split_outside_parens(c: Column, marks: str = ",;|•*") -> Column:
    """Parts between marks that stand outside parentheses; a stray closing one is ignored; blank parts go."""
    step = F.aggregate(
        F.split(c, ""),
        F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")),
        lambda s, ch: F.struct(
            F.when(ch == "(", s["depth"] + 1).when(ch == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]).alias("depth"),
            F.concat(s["out"], F.when((s["depth"] == 0) & F.lit(marks).contains(ch) & (ch != ""), "\u0001").otherwise(ch)).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.filter(F.transform(F.split(step, "\u0001"), lambda p: F.trim(p)), lambda p: p != "")


def lookup(c: Column, names: Mapping[str, str]) -> Column:
    """Canonical spelling by lower-cased key; unknown values stay."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in (kv[0].lower(), kv[1])])
    return F.coalesce(F.element_at(table, F.lower(c)), c)


#: Words that no spoken language's entry has, and words of lines that bled in from other sections (fixed values; patterns of whole words).
TOOL_WORDS = ("git", "aws", "java", "spring", "docker", "jenkins", "tools", "platforms")
BLEED_WORDS = (r"led\s+[0-9]+", "mentored", "championship", r"table\s+tennis", r"core\s+committee", r"teaching\s+assistant", "conference", "doubles")


def sentences(c: Column) -> Column:
    """Sentences with their end marks; blank ones go."""
    found = F.regexp_extract_all(F.regexp_replace(c, r"\s+", " "), F.lit(r"([^.!?]+[.!?]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def split_trailing(c: Column, pattern: str) -> Column:
    """(left, right) where right is a trailing match of the pattern; right is blank if there is none."""
    right = F.regexp_extract(c, f"({pattern})[\\s]*$", 1)
    return F.struct(F.trim(F.when(right != "", F.regexp_replace(c, f"({pattern})[\\s]*$", "")).otherwise(c)).alias("left"), right.alias("right"))


def month_range(start: Column, end: Column) -> Column:
    """'Jan 2020 - Mar 2021'; an open end is left out."""
    return F.concat_ws(" - ", F.date_format(start, "MMM yyyy"), F.date_format(end, "MMM yyyy"))


def json_object(c: Column) -> Column:
    """The outermost {...} of a reply, without code fences; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, "```[a-z]*", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def outside_strings(c: Column) -> Column:
    """A JSON text without its strings, so that brackets inside them do not count; an open string goes to the end."""
    return F.regexp_replace(c, r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?$)', "")


def looks_cut_off(c: Column) -> Column:
    """Whether a JSON reply seems truncated: under 40 characters, more brackets open than closed (outside strings), or a letter, digit
    or backslash at its end."""
    t = F.trim(c)
    bare = outside_strings(t)
    count = lambda mark: F.length(bare) - F.length(F.regexp_replace(bare, mark, ""))
    return (F.length(t) < 40) | (count(r"\{") > count(r"\}")) | (count(r"\[") > count(r"\]")) | t.rlike(r"[\p{L}\p{N}\\]$")


# ---------------------------------------------------------------- predicates


def is_heading(c: Column, max_words: int = 6, max_chars: int = 40) -> Column:
    """Short, has a letter, and does not end like a sentence."""
    t = squash(c)
    return (t != "") & (n_words(t) <= max_words) & (F.length(t) < max_chars) & ~t.rlike(r"[.!?,;:]$") & t.rlike("[A-Za-z]")


def is_mashed(c: Column, min_chars: int = 40, density: float = 0.08, long_word: int = 22) -> Column:
    """Text whose spaces got lost: few spaces per letter, or two very long letter runs."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    spaces = F.length(F.regexp_replace(c, "[^ ]", ""))
    runs = F.size(F.regexp_extract_all(c, F.lit(f"([A-Za-z]{{{long_word},}})"), F.lit(1)))
    return (F.length(c) >= min_chars) & (letters >= min_chars) & ((spaces / letters < density) | (runs >= 2))


def is_noise(c: Column) -> Column:
    """Boilerplate lines: licences, rights, contact labels, bare addresses, several bullets, glued columns."""
    low = F.lower(c)
    return (
        low.rlike(r"licensed under|all rights reserved|copyright|cookie|terms of (use|service)|subscribe")
        | low.rlike(r"^\s*(e-?mail|phone|tel|address)\s*:")
        | c.rlike(r"^\s*https?://[^\s]+\s*$")
        | (F.length(c) - F.length(F.regexp_replace(c, "[|•]", "")) >= 2)
    )


def is_garbage(c: Column) -> Column:
    """Code, command and markup dumps."""
    opens = F.length(c) - F.length(F.regexp_replace(c, r"\(", ""))
    closes = F.length(c) - F.length(F.regexp_replace(c, r"\)", ""))
    calls = (opens >= 2) & (closes >= 2) & (F.length(c) > 80) & c.rlike(r"[a-z]\.[a-z]+\(")
    return calls | c.rlike(r"[{};]\s*$|^\s*(sudo|pip|npm|git) |</?[a-z]+>") | (F.length(F.regexp_replace(c, "[^#$%&*<>|!]", "")) * 4 > F.length(c))


def is_continuation(line: Column, before: Column, wrap: int = 60) -> Column:
    """Whether a line carries on the one before: it starts small or with a conjunction, or the other was long and open."""
    starts_small = line.rlike("^[a-z]")
    joins = F.lower(line).rlike("^(and|or|with|using|for|to|of) ")
    open_end = ~before.rlike(r"[.;:!?]\s*$") & (F.length(before) >= wrap)
    return before.isNotNull() & (line != "") & (joins | (starts_small & ~before.rlike(r"[.;:!?]\s*$")) | (open_end & (n_words(line) <= 12) & starts_small))


def title_kind(c: Column) -> Column:
    """'blank', 'sentence', 'location' or 'title'."""
    t = squash(F.regexp_replace(c, r"\b(Jr|Sr|Dr)\.", "$1"))
    return (
        F.when(t == "", "blank")
        .when(t.rlike(r"^[A-Z][A-Za-z]+, [A-Z]{2}$"), "location")
        .when((F.length(t) > 110) | t.contains(". ") | t.rlike("^[a-z]") | (n_words(t) >= 14) | (t.rlike(r"\.$") & (n_words(t) >= 6)), "sentence")
        .otherwise("title")
    )
