"""Paragraphs and summaries as lists of items, in batches; both run along a text once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs that begin an item of its own (fixed values).
VERBS = (
    "Architected", "Developed", "Designed", "Implemented", "Built", "Led", "Created", "Improved", "Optimized", "Deployed", "Integrated", "Managed", "Delivered", "Engineered", "Collaborated",
    "Mentored", "Configured", "Migrated", "Reduced", "Increased", "Automated", "Established", "Owned", "Supported", "Analyzed", "Processed", "Enabled", "Wrote", "Maintained", "Refactored",
    "Troubleshot", "Coordinated", "Partnered", "Worked", "Responsible", "Spearheaded", "Drove", "Executed", "Enhanced", "Launched", "Conducted", "Performed", "Utilized", "Leveraged",
)
_GLYPH = re.compile(r"(?:^|(?<=\s))[•●◦▪*]\s+")
_AT_VERB = re.compile(r"(?<=[.!?])\s+(?=[A-Z])(?=(?i:" + "|".join(VERBS) + r")\b)")
_END = re.compile(r"[.!?](?:\s|$)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z(])")
_MARK = re.compile(r"(?:\r?\n)+|•+|(?:^|\s)[-–—]\s+")
_HAS_MARK = re.compile(r"[•\n\r]|(?:^|\s)[-–—]\s+")
_STRING = re.compile(r'''"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)\'''', re.S)


def _squash(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def firsts(items: Iterable[str], key: Callable[[str], str], least: int) -> list[str]:
    """Items whose key has ``least`` characters, the first of each key."""
    out: dict[str, str] = {}
    for x in items:
        k = key(x)
        if len(k) >= least:
            out.setdefault(k, x)
    return list(out.values())


def by_verbs(text: str | None, most: int = 20) -> list[str]:
    """A paragraph as items: parts between bullet glyphs; a part of 180 characters and two sentences is cut before sentences that begin with
    a verb of work, others stay joined. Items of 12 letters and digits, the first of equals, ``most`` at most."""
    parts = (p.strip(" -•\t") for p in _GLYPH.split(_squash((text or "").strip())))
    cut = (x for p in parts if p for x in (_AT_VERB.split(p) if len(p) >= 180 and len(_END.findall(p)) >= 2 else [p]))
    return firsts(cut, lambda x: re.sub("[^a-z0-9]+", "", x.lower()), 12)[:most]


def of_summary(text: str | None) -> list[str]:
    """A summary as items: a list that was written as text by its strings; else parts at bullets, dashes and line ends, if there are any; else
    sentences, unless it is short. Items of 12 characters, the first of equals, without what is left of lists; eight or more that are short on
    average are joined and cut by sentences again."""
    text = (text or "").strip(" ")
    strings = [re.sub(r"\\(.)", r"\1", a or b, flags=re.S) for a, b in _STRING.findall(text)] if text[:1] == "[" and text[-1:] == "]" else []
    if strings:
        parts = strings
    elif _HAS_MARK.search(text):
        parts = _MARK.split(text)
    else:
        parts = [text] if len(text) < 160 and text.count(".") <= 1 else _SENTENCE.split(text)
    clean = (_squash(p.strip(" \t•-–—[]'\"")) for p in parts)
    whole = (x for x in clean if not (x.startswith("[") or x.endswith("]") or (x.count("'") >= 2 and len(x) < 40)))
    items = firsts(whole, str.lower, 12)
    if len(items) < 8 or sum(map(len, items)) >= 60 * len(items):
        return items
    joined = " ".join(items)
    return [s for x in _SENTENCE.split(joined) if len(s := x.strip()) >= 12] or [joined]


def verb_items(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(by_verbs), "array<string>")(c)


def summary_items(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(of_summary), "array<string>")(c)
