"""Repair of spaces that extraction lost: words are found again in a lexicon, names and addresses stay whole.

A line is worked on only if its spaces are few for its letters, or it has a run of 14 letters; lines with an @ that is no
address are left alone. Texts of normal density in which no run could be cut come back as they were, but for their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .glossary import PROTECTED, restore

#: Words that runs are cut into (fixed values).
LEXICON = frozenset("""
the and with for from into using based ready native system systems service services agent agents model models data cloud backend frontend platform platforms
interview candidate resume parsing evaluation workflow workflows tool tools search vector database databases context protocol semantic multi real time voice question generation insights
production grade business impact strong focus world architected developed designed implemented built improved enabled processed optimized deployed integrated containerized
reducing achieving performing engineering learning language processing specialization certified program committee member mentored students teaching assistant championship table tennis
specializing building applications experienced developing scalable solutions enterprise integrations reliability observability graduate expertise institute college university
bachelor master technology computer science python docker kubernetes machine deep natural large prompt retrieval augmented engineer developer technologies
celery redis intelligent matching analysis structured outputs fallback strategies guardrails routing bedrock transcribe polly enabling automated recruiter velocity
windsurf delivering across multiple document sources measured citation backed answer financial records cleaning feature imputation outlier handling robust classification
streamlit experiment tracking loan conversational external capabilities interactive experiences kharagpur leadership achievements certifications conference
answering cross encoder ranking accuracy metrics documents through quality improving
""".split())
#: Letters of a word that a run is cut at, and of a run that is looked at.
SHORTEST, LONGEST, RUN = 4, 24, 10

_KEEP = re.compile(
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b|(?i:https?://[^\s<>\"']+)|(?<![A-Za-z0-9])(?:"
    + "|".join(re.escape(t) for t in PROTECTED) + r")(?![A-Za-z0-9])")
_KEPT = re.compile("\ue000([0-9]+)\ue001")  # private characters, which no text is cut at
_SEAMS = tuple((re.compile(p), r"\1 \2") for p in ("([a-z])([A-Z])", r"([A-Za-z])(\d)", r"(\d)([A-Za-z])"))


def _grow() -> dict:
    """The lexicon's words of four letters or more as a trie; the key '' ends a word."""
    root: dict = {}
    for word in LEXICON:
        if SHORTEST <= len(word) <= LONGEST:
            node = root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = {}
    return root


_TRIE = _grow()


def _longest(word: str, at: int) -> int:
    """End of the longest lexicon word that starts there, or ``at``."""
    node, best = _TRIE, at
    for i in range(at, len(word)):
        node = node.get(word[i])
        if node is None:
            break
        if "" in node:
            best = i + 1
    return best


def segment(run: str) -> str:
    """A run of letters as words: from the left the longest word each; letters between join. Runs with less than two words stay."""
    if len(run) < RUN:
        return run
    low, parts, at = run.lower(), [], 0
    while at < len(low):
        end = _longest(low, at)
        if end > at:
            parts.append(low[at:end])
        elif parts and parts[-1] not in LEXICON:
            end = at + 1
            parts[-1] += low[at]
        else:
            end = at + 1
            parts.append(low[at])
        at = end
    known = sum(p in LEXICON for p in parts)
    return " ".join(parts) if known >= 2 and len(parts) > 1 else run


def _letters(text: str, kept: int = 0) -> int:
    """Letters; what is kept counts as a word of four."""
    return sum(map(str.isalpha, text)) + 4 * kept


def _line(line: str) -> str:
    low = line.lower()
    if not line.strip() or "@" in line or "http://" in low or "https://" in low:
        return line
    letters = _letters(line, len(_KEPT.findall(line)))
    if letters < 16 or (line.count(" ") / max(letters, 1) >= 0.12 and not re.search("[A-Za-z]{14}", line)):
        return line
    cut = re.sub("[A-Za-z]+", lambda m: segment(m[0]), line)
    return re.sub(r"\s+", " ", cut).strip()


def repair(text: str | None) -> str | None:
    """The text with lost spaces put back. Under 24 characters it stays; under 24 letters only names are restored."""
    if not text or len(text) < 24:
        return text
    letters = _letters(text)
    if letters < 24:
        return restore(text)
    saved: list[str] = []

    def keep(m: re.Match) -> str:
        saved.append(m[0])
        return f"\ue000{len(saved) - 1}\ue001"

    out = _KEEP.sub(keep, text)
    for seam, spaced in _SEAMS:
        out = seam.sub(spaced, out)
    before = out.splitlines()
    after = [_line(x) for x in before]
    changed = any(a != b.strip() for a, b in zip(after, before, strict=True) if a != b)
    dense = text.count(" ") / letters >= 0.10
    if dense and not changed:
        return restore(text)
    put_back = _KEPT.sub(lambda m: saved[int(m[1])] if int(m[1]) < len(saved) else m[0], "\n".join(after))
    return restore(put_back)


def repair_spaces(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(repair, na_action="ignore"), "string")(c)
