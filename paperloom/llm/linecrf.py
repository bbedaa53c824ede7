"""Quality rules and line labelling with a linear-chain conditional random field.

Base rules are counts over the whole text (words, symbols, repeated lines,
words in repeated three-word windows). The method labels each line content or
boilerplate by Viterbi decoding; a document is kept if content lines hold at
least ``share`` of its words' bytes and no base rule failed.

The model is trained here, on at most ``train_docs`` labelled documents (those
with the smallest crc32 of their id, in at most ``train_bytes``): lines of documents marked good start as
content, lines of documents marked bad as boilerplate; rounds of relabelling by
the lines' own features, under the rule that a bad document has at least half
boilerplate, let the ordinary lines of bad documents become content before the
chain is fitted.

Edge cases: null and empty texts have no words (base rules fail); a line
without words has no features but its neighbours'; repeated rows are judged
alike; without labelled rows of both kinds every line is content; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import gram_hashes, lean, mix, slices, text_buffer, word_hashes, word_spans

#: Fixed: the characters that the contract calls symbols.
SYMBOLS = b"#*$%&|<>"
_KIND = np.zeros((256, 6), np.float32)  # letter, upper, digit, symbol, other mark, space
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _KIND[_b, 0] = 1
    elif _c.isalpha():
        _KIND[_b, 0] = 1
        _KIND[_b, 1] = _c.isupper()
    elif _c.isdigit():
        _KIND[_b, 2] = 1
    elif _b in SYMBOLS:
        _KIND[_b, 3] = 1
    elif _c.isspace():
        _KIND[_b, 5] = 1
    else:
        _KIND[_b, 4] = 1
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _CLASS[_b] = 5 if _KIND[_b, 5] else 3 if _KIND[_b, 3] else 2 if _KIND[_b, 2] else 4 if _KIND[_b, 4] else 1 if _KIND[_b, 1] else 0
FEATURES = 14


class Lines:
    """Lines of a slice of documents: bounds, words, features."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        self.starts, self.ends, self.first = word_spans(raw, offsets)
        self.hashes = word_hashes(raw, self.starts, self.ends)
        breaks = np.flatnonzero(raw == 10)
        # a document has one line more than it has breaks
        self.begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(breaks, offsets)) + 1)
        last = np.ones(len(self.doc), bool)
        last[:-1] = self.doc[1:] != self.doc[:-1]
        self.end = np.empty_like(self.begin)
        self.end[:-1] = self.begin[1:] - 1
        self.end[last] = offsets[1:]
        self.first_line = np.concatenate(([0], np.flatnonzero(last) + 1))
        self.word_lo = np.searchsorted(self.starts, self.begin)
        self.word_hi = np.searchsorted(self.starts, self.end)
        self.words = self.word_hi - self.word_lo

    def copies(self) -> np.ndarray:
        """Whether a line with a word equals an earlier line of its document (by 64-bit hash of the line)."""
        h = word_hashes(self.raw, self.begin, self.end)
        key = mix(h + mix(self.doc.astype(np.uint64) + np.uint64(11)))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        return again & (self.words > 0)

    def features(self) -> np.ndarray:
        cls = _CLASS[self.raw]
        n = len(self.begin)
        counts = np.zeros((n, 6), np.float64)
        for j in range(6):
            c = np.concatenate(([0], np.cumsum(cls == j)))
            counts[:, j] = c[self.end] - c[self.begin]
        seen = np.maximum(1, counts[:, :5].sum(1))
        words = np.maximum(1, self.words)
        letters = np.maximum(1, counts[:, 0] + counts[:, 1])
        x = np.zeros((n, FEATURES), np.float64)
        x[:, 0] = self.words > 0
        x[:, 1] = counts[:, 1] / letters
        x[:, 2] = counts[:, 2] / seen
        x[:, 3] = counts[:, 3] / seen
        x[:, 4] = counts[:, 4] / seen
        x[:, 5] = counts[:, 3] / words > 0.3
        x[:, 6] = counts[:, 1] / letters > 0.6
        x[:, 7] = counts[:, 4] / words > 0.6
        x[:, 8] = np.minimum(2, seen / words / 8)
        x[:, 9] = np.minimum(2, counts[:, 4] / words)
        x[:, 10] = counts[:, 1] / words > 2
        x[:, 11] = self.copies()
        x[:, 12] = np.minimum(2, counts[:, 3] / words)
        x[:, 13] = counts[:, 2] / words > 0.5
        return x

    def mass(self) -> np.ndarray:
        """Bytes of words in each line."""
        c = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        return c[self.word_hi] - c[self.word_lo]


def base_counts(lines: Lines, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per document."""
    docs = len(offsets) - 1

    def per_doc(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(flags)))
        return c[offsets[1:]] - c[offsets[:-1]]

    chars = (raw & 0xC0) != 0x80
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    symbol = np.isin(raw, np.frombuffer(SYMBOLS, np.uint8))
    dup = np.bincount(lines.doc[lines.copies()], minlength=docs)
    first = lines.first
    repeat = np.zeros(docs, np.int64)
    grams = gram_hashes(lines.hashes, 3)
    if len(grams):
        doc = np.repeat(np.arange(docs), np.diff(first))
        inside = np.flatnonzero(doc[: len(grams)] == doc[2:])
        key = mix(grams[inside] + mix(doc[inside].astype(np.uint64) + np.uint64(5)))
        order = np.argsort(key)
        same = np.zeros(len(key), bool)
        equal = key[order[1:]] == key[order[:-1]]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
        hit = inside[same]
        cover = np.zeros(len(lines.hashes), bool)
        cover[hit] = cover[hit + 1] = cover[hit + 2] = True
        repeat = np.bincount(doc[cover], minlength=docs)
    return [np.diff(first), per_doc(chars & ~space), per_doc(symbol), dup, repeat]


class LineCrf:
    """Two labels (0 content, 1 boilerplate): weights of features and of label pairs."""

    def __init__(self) -> None:
        self.unary = np.zeros((FEATURES + 1, 2))
        self.pair = np.zeros((2, 2))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.unary[:-1] + self.unary[-1]

    def decode(self, s: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi over all documents at once, a step per line position; documents leave as they end."""
        n = np.diff(first)
        label = np.zeros(len(s), np.int8)
        if not len(s):
            return label
        order = np.argsort(-n, kind="stable")
        begin, n = first[:-1][order], n[order]
        back = np.zeros((len(s), 2), np.int8)
        best = s[begin].copy()
        final = np.zeros((len(n), 2))
        alive = len(n)
        for t in range(1, int(n[0]) + 1):
            stay = int(np.searchsorted(-n, -t, side="left"))  # documents with more than t lines
            final[stay:alive] = best[stay:alive]
            if not stay:
                break
            reach = best[:stay, :, None] + self.pair[None]
            at = begin[:stay] + t
            back[at] = reach.argmax(1)
            best = reach.max(1) + s[at]
            alive = stay
        now = final.argmax(1).astype(np.int8)
        for t in range(int(n[0]) - 1, -1, -1):
            live = int(np.searchsorted(-n, -t, side="left"))
            at = begin[:live] + t
            label[at] = now[:live]
            now[:live] = back[at, now[:live]]
        return label

    def fit(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, chain: bool, rounds: int = 400, rate: float = 2.0, ridge: float = 1e-4) -> None:
        """Gradient ascent on the exact log-likelihood (forward-backward), with momentum. Without chain, pairs stay 0."""
        xb = np.hstack([x, np.ones((len(x), 1))])
        inner = np.ones(len(x), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        later = np.flatnonzero(inner)
        seen_u = np.zeros_like(self.unary)
        for k in (0, 1):
            seen_u[:, k] = xb[y == k].sum(0)
        seen_p = np.zeros((2, 2))
        np.add.at(seen_p, (y[later - 1], y[later]), 1)
        vel_u, vel_p = np.zeros_like(self.unary), np.zeros((2, 2))
        for _ in range(rounds):
            node, edge = self._marginals(self.scores(x), first)
            vel_u = 0.9 * vel_u + rate * ((seen_u - xb.T @ node) / len(x) - ridge * self.unary)
            vel_p = 0.9 * vel_p + rate * ((seen_p - edge) / len(x) - ridge * self.pair)
            self.unary += vel_u
            if chain:
                self.pair += vel_p

    def _marginals(self, s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        begin, n = first[:-1][order], n[order]
        fwd, bwd = s.copy(), np.zeros_like(s)
        lse = np.logaddexp
        for t in range(1, int(n[0])):
            at = begin[: int(np.searchsorted(-n, -t, side="left"))] + t
            a = fwd[at - 1][:, :, None] + self.pair[None]
            fwd[at] += lse(a[:, 0], a[:, 1])
        for t in range(int(n[0]) - 2, -1, -1):
            at = begin[: int(np.searchsorted(-n, -(t + 1), side="left"))] + t
            a = (bwd[at + 1] + s[at + 1])[:, None, :] + self.pair[None]
            bwd[at] = lse(a[:, :, 0], a[:, :, 1])
        node = fwd + bwd
        node = np.exp(node - lse(node[:, 0], node[:, 1])[:, None])
        inner = np.ones(len(s), bool)
        inner[begin[n > 0]] = False
        at = np.flatnonzero(inner)
        e = fwd[at - 1][:, :, None] + self.pair[None] + (s[at] + bwd[at])[:, None, :]
        e = np.exp(e - e.max((1, 2), keepdims=True))
        e /= e.sum((1, 2), keepdims=True)
        return node, e.sum(0)


def train(texts: list[str], quality: list[int], passes: int = 3) -> LineCrf:
    """A model from documents marked good (1) or bad (0)."""
    crf = LineCrf()
    if len(set(quality)) < 2:
        crf.unary[-1, 0] = 1.0
        return crf
    raw, offsets, _ = text_buffer(pa.array(texts, pa.large_string()))
    lines = Lines(raw, offsets)
    x, mass = lines.features(), lines.mass()
    bad = np.array(quality)[lines.doc] == 0
    y = bad.astype(np.int8)
    for k in range(passes):
        crf.fit(x, y, lines.first_line, chain=k + 1 == passes)
        if k + 1 == passes:
            break
        node, _ = crf._marginals(crf.scores(x), lines.first_line)
        y = (bad & (node[:, 1] > 0.5)).astype(np.int8)
        # a bad document stays at least half boilerplate
        total = np.bincount(lines.doc, mass, len(texts))
        junk = np.bincount(lines.doc, mass * y, len(texts))
        short = (np.array(quality) == 0) & (junk < 0.5 * total)
        y[short[lines.doc]] = 1
    return crf


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, keep: F.Column | None = None, train_bytes: int = 16 << 20) -> tuple[list[str], list[int]]:
    """At most ``bound`` labelled texts of each quality, those with the smallest crc32 of the id, and of them at most
    ``train_bytes`` bytes; a text of over a sixteenth of that is not learnt from. Of rows that share an id the text that
    sorts first stands for all."""
    texts, marks = [], []
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if keep is not None:
        known = known.where(keep)
    fits = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= train_bytes // 16)
    for q in (0, 1):
        ids = known.where(F.col("quality") == q).orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(bound)
        rows = fits.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        # at most ``bound`` rows
        so_far = F.sum(F.octet_length("text")).over(W.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id"))
        for r in sorted(rows.withColumn("so_far", so_far).where(F.col("so_far") <= train_bytes).collect(), key=lambda r: r.doc_id):
            texts.append(r.text)
            marks.append(q)
    return texts, marks


def line_rules(docs: DataFrame, labels: DataFrame, share: float = 0.5, train_docs: int = 600) -> DataFrame:
    """doc_id, base counts, base_failed, kept, n_lines, content_share for each row of docs(doc_id, text)."""
    crf = train(*labelled_sample(docs, labels, train_docs))
    kind = docs.schema["doc_id"].dataType
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, off_all, _ = text_buffer(batch.column(1))
            for lo, hi in slices(off_all):
                raw, offsets = raw_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                lines = Lines(raw, offsets)
                counts = base_counts(lines, raw, offsets)
                failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
                label = crf.decode(crf.scores(lines.features()), lines.first_line)
                mass = lines.mass()
                total = np.bincount(lines.doc, mass, hi - lo)
                good = np.bincount(lines.doc, mass * (label == 0), hi - lo)
                content = np.divide(good, total, out=np.zeros(hi - lo), where=total > 0)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(c.astype(np.int64)) for c in counts], pa.array(failed), pa.array(~failed & (content >= share)),
                     pa.array(np.diff(lines.first_line).astype(np.int64)), pa.array(content)],
                    names=["doc_id", *names, "base_failed", "kept", "n_lines", "content_share"],
                )

    schema = f"doc_id {kind.simpleString()}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, n_lines long, content_share double"
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)
