"""Personal data: patterns, and a skip-chain conditional random field over the rest.

Base spans come from four patterns with their own checks. The field labels the
words that hold a digit or an @ (all other words are fixed to "none"): a word's
evidence is a log-linear model of its form and of the run of number words that it stands in; neighbouring words
share a chain potential; words with a common key share a skip potential along the document, however far apart. Keys are
the form (six characters or more, as written or its letters and digits alone), the digits (six or more), the last
seven digits, the same two of a run of neighbouring number words (of at most 19 digits), and the part before an @ (four
characters or more). Loopy sum-product passes beliefs over both kinds of edges, with base spans as
observed labels, so an unclear word follows its clear repetitions. Words that the field labels and no base span touches
become further spans.

Base spans are kept as they are. A word has one skip edge a key, to the run before its own that has the key,
so a document of one repeated word stays linear; words of one run are neighbours and share the chain's potential only.

All potentials are learnt here, together, by pseudo-likelihood and then by the likelihood under message passing, on at most ``train_docs`` documents with a digit
or an @ (those with the smallest crc32 of their id, in at most ``train_bytes`` and ``train_words`` such words), labelled by the base spans;
forms that the checks refuse count as "none". So that context and repetition carry labels that the patterns cannot see,
training documents also get damaged repetitions of their own entities (no plus, no check, other separators), labelled as
the entity, forms of the same make that repeat nothing, labelled "none", and other entities that pass the checks but for
a number behind them that the patterns read on into.

Edge cases: null and empty texts have no spans; repeated rows are treated alike;
an empty table gives an empty result; without training documents nothing is
added to the base.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import lean, slices, text_buffer

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit before the match's start would have been part of it
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SUSPECT = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]+")


def _digits(s: str) -> str:
    return _DIGITS.sub("", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.tld, found from each @ outwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _SUSPECT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- the field

_EDGES_OF = (1, 2, 3, 5, 8, 12, 16, 20)
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&="
_GROUPS = re.compile(r"[0-9]+")
_NOT_WORD = re.compile(r"[^a-z0-9]+")


def _form(word: str) -> str:
    return word.strip(_STRIP).lower()


def _at(form: str) -> str:
    return form.replace("(at)", "@").replace("[at]", "@")


def runs(words: list[str], digits: list[int], at: list[int]) -> list[tuple[int, int]]:
    """(first, last) word of the run of neighbouring number words that each suspicious word stands in. Number words have no
    letters, at most eight digits and less than two dots; any other word is a run of its own."""

    def short(i: int) -> bool:
        return 0 < digits[i] <= 8 and words[i].count(".") < 2 and not any(c.isalpha() for c in words[i])

    out: list[tuple[int, int]] = []
    k = 0
    while k < len(at):
        end = k
        if short(at[k]):
            while end + 1 < len(at) and at[end + 1] == at[end] + 1 and short(at[end + 1]) and "+" not in words[at[end + 1]]:
                end += 1
        out += [(at[k], at[end])] * (end + 1 - k)
        k = end + 1
    return out


def features(words: list[str], digits: list[int], i: int, run: tuple[int, int]) -> list[int]:
    """Active features of a suspicious word among a document's words (digits: of each word, by position)."""
    w = words[i]
    core = _form(w)
    d = digits[i]
    f = [0, 1 + sum(d >= k for k in _EDGES_OF)]
    f.append(10 + min(3, core.count("@")))
    f.append(14 + min(4, core.count(".")))
    f.append(19 + min(3, core.count("-")))
    f.append(23 + min(3, sum(c.isalpha() for c in core) * 4 // max(1, len(core))))
    if "+" in w[:2]:
        f.append(27)
    if "(" in w or ")" in w:
        f.append(28)
    groups = _GROUPS.findall(core)
    quad = len(groups) == 4 and all(len(p) < 4 and int(p) < 256 for p in groups) and not any(c.isalpha() for c in core)
    if quad:
        f.append(29 if core.count(".") == 3 else 48)
    if "@" in core and "." in core.rpartition("@")[2].strip(".") and core[0] != "@":
        f.append(30)
    text = " ".join(words[run[0] : run[1] + 1])
    number = _digits(text)
    f.append(31 + sum(len(number) >= k for k in _EDGES_OF))
    if 12 <= len(number) <= 19 and luhn(number):
        f += [40, 50] if core.isdigit() else [40]
    if "+" in text:
        f.append(41 if 9 <= len(number) <= 15 else 42)
    f.append(43 + min(2, run[1] - run[0]))
    if run[0] < run[1] and 12 <= d <= 19 and luhn(_digits(w)):
        f.append(46)
    if "@" in _at(core) and "@" not in core:
        f.append(47)
    if 7 <= len(number) <= 11 and len(_GROUPS.findall(text)[-1]) == 4:
        f.append(49)
    return f


FEATURES = 51


def suspects(text: str) -> tuple[list[str], list[tuple[int, int]], list[int], list[int]]:
    """Words, their spans, digits per word, and the indexes of the suspicious ones."""
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b] for a, b in spans]
    at = [i for i, w in enumerate(words) if _SUSPECT.search(w)]
    digits = [0] * len(words)
    for i in at:
        digits[i] = len(_digits(words[i]))
    return words, spans, digits, at


class Field:
    """Unary weights, chain and skip potentials (logs); beliefs by loopy sum-product."""

    def __init__(self) -> None:
        self.w = np.zeros((FEATURES, len(LABELS)))
        self.chain = np.zeros((len(LABELS), len(LABELS)))
        self.skip = np.zeros((len(LABELS), len(LABELS)))

    def unary(self, active: list[list[int]]) -> np.ndarray:
        return np.array([self.w[f].sum(0) for f in active]) if active else np.zeros((0, len(LABELS)))

    def beliefs(self, unary: np.ndarray, edges: list[tuple[int, int, bool]], rounds: int = 12, damp: float = 0.3) -> np.ndarray:
        """Marginals; edges (a, b, skip). Messages go both ways along every edge, all at once."""
        return self._pass(unary, _Edges(edges), rounds, damp)[0]

    def _pass(self, unary: np.ndarray, g: _Edges, rounds: int, damp: float) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of words, of the pairs at each edge's ends)."""
        if not g.n:
            return np.exp(unary - _lse(unary)), np.zeros((0, len(LABELS), len(LABELS)))
        pot = np.where(g.skip[:, None, None], self.skip, self.chain)
        pot = np.concatenate((pot, pot.transpose(0, 2, 1)))
        msg = np.zeros((2 * g.n, len(LABELS)))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, g.dst, msg)
            out = _lse((total[g.src] - msg[g.back])[:, :, None] + pot, 1)[:, 0, :]
            out -= _lse(out)
            msg = damp * msg + (1 - damp) * out
        total = unary.copy()
        np.add.at(total, g.dst, msg)
        a, b = g.src[: g.n], g.dst[: g.n]
        pair = pot[: g.n] + (total[a] - msg[g.n :])[:, :, None] + (total[b] - msg[: g.n])[:, None, :]
        pair = np.exp(pair - pair.max((1, 2), keepdims=True))
        return np.exp(total - _lse(total)), pair / pair.sum((1, 2), keepdims=True)

    def fit(self, active: list[list[int]], y: np.ndarray, edges: list[tuple[int, int, bool]], observed: np.ndarray, rounds: int = 400, joint: int = 150, rate: float = 1.5, ridge: float = 3e-5) -> None:
        """All potentials together, by gradient ascent with momentum; the skip potential is symmetric.

        First by pseudo-likelihood (each word's label given its evidence and its neighbours' labels), then by the likelihood
        with marginals from message passing, where ``observed`` words are given as they are when the field is used.
        """
        x = np.zeros((len(active), FEATURES))
        for i, f in enumerate(active):
            x[i, f] = 1
        k, g = len(LABELS), _Edges(edges)
        target = np.eye(k)[y]
        left, right, far = (np.zeros((len(y), k)) for _ in range(3))
        for a, b, s in edges:
            if s:
                far[a, y[b]] += 1
                far[b, y[a]] += 1
            else:
                right[a, y[b]] += 1
                left[b, y[a]] += 1
        given = target * np.where(observed & (y > 0), _CLEAR, 0)[:, None]
        true = target[g.src[: g.n]][:, :, None] * target[g.dst[: g.n]][:, None, :]
        vel = [np.zeros_like(self.w), np.zeros_like(self.chain), np.zeros_like(self.skip)]
        for t in range(rounds + joint):
            if t < rounds:
                z = x @ self.w + left @ self.chain + right @ self.chain.T + far @ self.skip
                off = target - np.exp(z - _lse(z))
                chain, skip = left.T @ off + (right.T @ off).T, far.T @ off
            else:
                node, pair = self._pass(x @ self.w + given, g, 10, 0.3)
                off, apart = target - node, true - pair
                chain, skip = apart[~g.skip].sum(0), apart[g.skip].sum(0)
            for v, d, p in zip(vel, (x.T @ off, chain, (skip + skip.T) / 2), (self.w, self.chain, self.skip), strict=True):
                v *= 0.9
                v += rate * (d / len(y) - ridge * p)
                p += v


class _Edges:
    """Both directions of edges (a, b, skip): n forth, then n back."""

    def __init__(self, edges: list[tuple[int, int, bool]]):
        self.n = len(edges)
        a, b = (np.array([e[j] for e in edges], np.int64) for j in (0, 1))
        self.src, self.dst = np.concatenate((a, b)), np.concatenate((b, a))
        self.back = np.concatenate((np.arange(self.n, 2 * self.n), np.arange(self.n)))
        self.skip = np.array([e[2] for e in edges], bool)


def _lse(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis, keepdims=True))


def keys(word: str, number: str) -> set[str]:
    """What a word may share with others: its form, digits, tail and the part before an @; number: its run's digits."""
    form, digits = _form(word), _digits(word)
    mail = _at(form)
    plain = _NOT_WORD.sub("", mail)
    out = {f"f{k}" for k in (form, plain) if len(k) >= 6}
    for n in {digits, number} if len(number) <= 19 else {digits}:
        if len(n) >= 6:
            out.add(f"d{n}")
        if len(n) >= 7:
            out.add(f"t{n[-7:]}")
    local = mail.partition("@")[0]
    if local != mail and len(local) >= 4:
        out.add(f"l{local}")
    return out


def graph(words: list[str], at: list[int], around: list[tuple[int, int]], offset: int) -> list[tuple[int, int, bool]]:
    """Chain and skip edges among the suspicious words, numbered from offset; around: their runs."""
    edges = [(offset + k, offset + k + 1, False) for k, (a, b) in enumerate(pairwise(at)) if b == a + 1]
    # key → first word of the run that had it last, its carrier, and the carrier of the run before that
    last: dict[str, tuple[int, int, int | None]] = {}
    for k, (i, (lo, hi)) in enumerate(zip(at, around, strict=True)):
        linked = set()
        for key in sorted(keys(words[i], _digits("".join(words[lo : hi + 1])) if hi - lo < 20 else "")):
            run, carrier, before = last.get(key, (lo, k, None))
            if run != lo:
                before = carrier
            if before is not None and before not in linked:
                edges.append((offset + before, offset + k, True))
                linked.add(before)
            last[key] = lo, k, before
    return edges


def _hit(base: list[tuple[int, int, int]], a: int, b: int) -> int:
    """Label that the base spans give to a word: the kind that covers over half of it."""
    hit = max(((min(b, e) - max(a, s), k) for s, k, e in base), default=(0, 0))
    return hit[1] + 1 if 2 * hit[0] > b - a else 0


#: Evidence (log) that a base span, which is observed, adds to its words' label.
_CLEAR = 12.0


def damaged(kind: int, entity: str, rng: np.random.Generator) -> str:
    """An entity as it may be repeated where the patterns do not see it."""
    d, pick = _digits(entity), rng.integers
    if kind == 0:
        local, _, host = entity.partition("@")
        return (f"{local}(at){host}", f"{local}[at]{host}", f"{local}@{host.partition('.')[0]}")[pick(3)]
    if kind == 1:
        return ("-", ",", "[.]", "_")[pick(4)].join(entity.split("."))
    if kind == 2:
        return (".", "/", "_")[pick(3)].join(d[i : i + 4] for i in range(0, len(d), 4))
    own = d[-10:]
    return (f"{own[:-7]}-{own[-7:-4]}-{own[-4:]}", f"({own[:-7]}) {own[-7:-4]}-{own[-4:]}", f"{own[:-7]} {own[-7:-4]} {own[-4:]}", f"{own[-7:-4]}-{own[-4:]}", d)[pick(5)]


def stranger(kind: int, rng: np.random.Generator) -> str:
    """A form of the same make that repeats nothing: a made-up number, or a name at a host."""
    if kind == 0:
        return f"{''.join(chr(97 + c) for c in rng.integers(0, 26, 6))}@{('localhost', 'home', 'node7')[rng.integers(3)]}"
    if kind == 1:
        return damaged(1, ".".join(str(n) for n in rng.integers(0, 400, 4)), rng)
    n = 16 if kind == 2 else 11
    return damaged(kind, "".join(str(c) for c in rng.integers(0, 10, n)), rng)


def other(kind: int, entity: str, rng: np.random.Generator) -> str:
    """An entity of the same form with other digits, which pass the same checks."""
    fresh = "".join(str(rng.integers(10)) if c.isdigit() and i > 2 else c for i, c in enumerate(entity))
    if kind == 2:
        fresh = next(f for n in range(10) if luhn(_digits(f := f"{fresh[:-1]}{n}")))
    return fresh


def planted(text: str, base: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with damaged repetitions of some of its entities and some strangers put between its words, and the spans
    (start, label, end) of both."""
    cuts = [m.start() for m in _WORD.finditer(text) if not any(a < m.start() < e for a, _, e in base)]
    put: list[tuple[int, int, str, str]] = []
    for a, k, e in base:
        if rng.random() < 0.6:
            put.append((cuts[rng.integers(len(cuts))], k + 1, damaged(k, text[a:e], rng), ""))
        if rng.random() < 0.6:
            put.append((cuts[rng.integers(len(cuts))], 0, stranger(int(rng.integers(4)), rng), ""))
        if k > 1 and rng.random() < 0.4:  # hidden by a number that the pattern reads on into
            put.append((cuts[rng.integers(len(cuts))], k + 1, other(k, text[a:e], rng), (".".join(str(n) for n in rng.integers(1, 256, 4)), "".join(str(c) for c in rng.integers(0, 10, 9)))[rng.integers(2)]))
    out, spans, done, size = [], [], 0, 0
    for at, label, piece, tail in sorted(put):
        out += [text[done:at], piece, " ", tail, " " * bool(tail)]
        size += at - done
        spans.append((size, label, size + len(piece)))
        size += len(piece) + 1 + len(tail) + bool(tail)
        done = at
    return "".join([*out, text[done:]]), spans


def train(texts: list[str], train_words: int = 10_000, seed: int = 11) -> Field | None:
    """A field from the texts in their order, until they have ``train_words`` suspicious words; texts with over a tenth of
    that are left out."""
    rng = np.random.default_rng(seed)
    active, labels, edges, clear = [], [], [], []
    for text in texts:
        base, more = base_spans(text), []
        if base:
            text, more = planted(text, base, rng)
            base = base_spans(text)
        words, spans, digits, at = suspects(text)
        if 10 * len(at) > train_words:
            continue
        if len(active) + len(at) > train_words:
            break
        around = runs(words, digits, at)
        edges += graph(words, at, around, len(active))
        for i, run in zip(at, around, strict=True):
            a, b = spans[i]
            label = _hit(base, a, b)
            clear.append(label > 0)
            if not label:
                label = next((k for s, k, e in more if s <= a and b <= e), 0)
            labels.append(label)
            active.append(features(words, digits, i, run))
    if not active:
        return None
    field = Field()
    # some clear words are left open, so that their evidence is learnt too
    field.fit(active, np.array(labels), edges, np.array(clear) & (rng.random(len(clear)) < 0.7))
    return field


def find(texts: list[str], field: Field | None, sure: float = 0.6, skips: bool = True) -> list[tuple[list, list]]:
    """Per text: base spans, and spans that the field adds with beliefs of at least ``sure``. skips: whether repetitions count."""
    found, active, edges, where, clear = [], [], [], [], []
    for t, text in enumerate(texts):
        base = base_spans(text)
        found.append((base, []))
        if field is None:
            continue
        words, spans, digits, at = suspects(text)
        around = runs(words, digits, at)
        edges += [e for e in graph(words, at, around, len(active)) if skips or not e[2]]
        reach = 0
        for i, run in zip(at, around, strict=True):
            active.append(features(words, digits, i, run))
            where.append((t, i, *spans[i], words[i]))
            # base spans are in order, those that end before this word are done with
            while reach < len(base) and base[reach][2] <= spans[i][0]:
                reach += 1
            clear.append(_hit(base[max(0, reach - 3) : reach + 5], *spans[i]))
    if not active:
        return found
    unary = field.unary(active)
    unary[np.arange(len(clear)), clear] += np.where(np.array(clear) > 0, _CLEAR, 0)
    belief = field.beliefs(unary, edges)
    pick = belief.argmax(1)
    last = (-1, -2, 0)
    for n in np.flatnonzero((pick > 0) & (belief.max(1) >= sure)).tolist():
        t, i, a, b, word = where[n]
        core = word.strip(".,;:!?\"'()[]{}<>|*#$%&=")
        a += word.find(core)
        b = a + len(core)
        base, more = found[t]
        if not core or clear[n] or _touches(base, a, b):
            continue
        kind = int(pick[n]) - 1
        if more and last == (t, i - 1, kind):
            more[-1] = (more[-1][0], kind, b)
        else:
            more.append((a, kind, b))
        last = (t, i, kind)
    return found


def _touches(base: list[tuple[int, int, int]], a: int, b: int) -> bool:
    """Whether a base span overlaps [a, b); base is sorted, and spans of one kind do not overlap."""
    k = bisect.bisect_left(base, (b, 0, 0))
    return any(e > a for _, _, e in base[max(0, k - 2 * len(KINDS)) : k])


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def training_texts(docs: DataFrame, bound: int, train_bytes: int = 16 << 20) -> list[str]:
    """Of at most ``bound`` documents, those that fit in ``train_bytes``; a text of over a sixteenth of that is not learnt
    from. Of rows that share an id the text that sorts first stands for all."""
    some = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull() & (F.octet_length("text") <= train_bytes // 16))
    place = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    ids = some.select("doc_id").distinct().orderBy(place, "doc_id").limit(bound)
    texts = some.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    # at most ``bound`` rows
    so_far = F.sum(F.octet_length("text")).over(W.orderBy(place, "doc_id"))
    return [r.text for r in sorted(texts.withColumn("so_far", so_far).where(F.col("so_far") <= train_bytes).collect(), key=lambda r: r.doc_id)]


def _found(column: pa.Array, field: Field | None) -> Iterator[tuple[int, int, list[str], list[tuple[list, list]]]]:
    """Slices of a batch: bounds, texts, spans. Texts without a digit or an @ have none of either kind."""
    raw, offsets, _ = text_buffer(column)
    mark = np.flatnonzero((raw == 64) | ((raw >= 48) & (raw <= 57)))  # few: a running count of all bytes takes sixteen times the batch
    some = np.diff(np.searchsorted(mark, offsets)) > 0
    for lo, hi in slices(offsets):
        at = np.flatnonzero(some[lo:hi])
        texts = column.slice(lo, hi - lo).take(pa.array(at)).to_pylist()
        got: list = [([], [])] * (hi - lo)
        for i, g in zip(at.tolist(), find(texts, field), strict=True):
            got[i] = g
        yield lo, hi, dict(zip(at.tolist(), texts, strict=True)), got


def detect(docs: DataFrame, train_docs: int = 2000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans (all spans) for each row of docs(doc_id, text)."""
    field = train(training_texts(docs, train_docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, got in _found(batch.column(1), field):
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in got], pa.int64()) for k in range(len(KINDS))]
                sha = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in got]
                spans = [_written([*base, *more]) for base, more in got]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *counts, pa.array(sha), pa.array(spans), pa.array([len(m) for _, m in got], pa.int64()), pa.array([len(b) + len(m) for b, m in got], pa.int64())], names=names)

    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long, n_spans long"
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def mask(docs: DataFrame, train_docs: int = 2000) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; other columns as they are."""
    field = train(training_texts(docs, train_docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts, got in _found(batch.column(at), field):
                column = batch.column(at).slice(lo, hi - lo)
                changed = {i: blank(texts[i], [*got[i][0], *got[i][1]]) for i in texts if got[i][0] or got[i][1]}
                if changed:
                    new = column.to_pylist()
                    for i, t in changed.items():
                        new[i] = t
                    column = pa.array(new, column.type)
                columns = [c.slice(lo, hi - lo) for c in batch.columns]
                columns[at] = column
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)


def blank(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spans replaced; overlapping spans are replaced together, under the first one's kind."""
    out, done = [], 0
    for a, k, b in sorted(spans):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])
