"""Language identification with interpolated Kneser-Ney character models.

All training texts but those kept for calibration are counted: character n-grams of order ``order`` per
language, combined per batch before they meet. Letters are lower-cased, runs of
anything else are one space. Lower orders follow from the distinct n-grams
(continuation counts), as Kneser-Ney asks. Each language's model is a set of
sorted hash arrays, one per order, with log-probabilities and back-off weights;
n-grams are hashed to 64 bits.

A text's score under a language is its mean negative log-probability per
character; the lowest wins. ``score`` is the winner's share of the normalised
likelihoods. ``rejected`` marks texts whose best cross-entropy lies above the
language's calibrated limit: ``limit_quantile`` of the cross-entropies of the language's calibration texts, which are one in
``calibrate`` of the texts that may be learnt from (by crc32 of the id) and which no model has counted, plus a margin.
Languages without such texts reject nothing.

The models are kept on the driver and sent to the executors; their size is that of the
languages' distinct n-grams, which saturates with the corpus. Every occurrence counts.

Edge cases: null texts and texts without a letter are ``und`` with score 0; a
text is judged whole; repeated rows are judged alike; null languages and
held-out rows are not learnt from; without anything to learn all are ``und``; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytecnn import held_out
from .common import lean, mix, slices, text_buffer


def _salt(order: int) -> np.uint64:
    return np.uint64(order * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


@functools.cache
def _letters() -> np.ndarray:
    """Lower-cased code point of each BMP letter, 0 for others."""
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def characters(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first, has_letter): cleaned texts one after another, each with order - 1 spaces (0) before it and one behind."""
    n = len(column)
    texts = column.fill_null("").to_pylist()
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, n)
    codes = np.where(cp < 0x10000, _letters()[np.minimum(cp, 0xFFFF)], 0)
    far = np.flatnonzero(cp >= 0x10000)
    for i in far.tolist():
        if chr(cp[i]).isalpha():
            codes[i] = ord(chr(cp[i]).lower())
    owner = np.repeat(np.arange(n), length)
    keep = codes > 0
    has = np.bincount(owner[keep], minlength=n) > 0
    gap = ~keep
    keep[1:] |= gap[1:] & ~gap[:-1] & (owner[1:] == owner[:-1])  # the first of a run, not at a text's beginning
    codes, owner = codes[keep], owner[keep]
    count = np.bincount(owner, minlength=n)
    first = np.concatenate(([0], np.cumsum(count + order)))
    out = np.zeros(first[-1], np.uint32)
    out[np.arange(len(codes)) + np.repeat(first[:-1] + order - 1 - np.concatenate(([0], np.cumsum(count)[:-1])), count)] = codes
    return out, first, has


def gram_codes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that starts at each position; the n-gram's own code points, combined reversibly, then mixed."""
    n = len(codes) - order + 1
    total = np.zeros(max(0, n), np.uint64)
    for j in range(order):
        total = total * np.uint64(0xD1342543DE82EF95) + codes[j : j + n] + np.uint64(1)
    return mix(total ^ _salt(order))


def _spots(first: np.ndarray, order: int) -> np.ndarray:
    """Positions at which a text's n-grams start (the last ends at the space behind the text)."""
    count = np.diff(first) - order + 1
    begin = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(count.sum()) + begin


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """lang, gram (its characters), n over docs(text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pd.factorize(np.asarray(batch.column(1)))
            _, offsets, _ = text_buffer(batch.column(0))
            for lo, hi in slices(offsets):
                codes, first, _ = characters(batch.column(0).slice(lo, hi - lo), order)
                at = _spots(first, order)
                owner = np.repeat(langs[0][lo:hi], np.diff(first) - order + 1)
                key = gram_codes(codes, order)[at]
                for k in np.unique(owner):
                    mine = at[owner == k]
                    number, unique = pd.factorize(key[owner == k])
                    n = np.bincount(number, minlength=len(unique))
                    place = np.empty(len(unique), np.int64)
                    place[number] = mine
                    text = codes[place[:, None] + np.arange(order)]
                    flat = np.where(text == 0, 32, text).astype("<u4").tobytes().decode("utf-32-le")
                    grams = [flat[i : i + order] for i in range(0, len(flat), order)]
                    yield pa.record_batch([pa.array([langs[1][k]] * len(unique), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(lean(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Interpolated Kneser-Ney: per order sorted hashes with log-probabilities, per context hash a back-off log-weight."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """grams: matrix of code points (a row per distinct n-gram of the highest order)."""
        order = self.order = grams.shape[1]
        self.hash, self.logp, self.ctx, self.back = {}, {}, {}, {}
        levels = {order: (grams, counts.astype(np.float64))}
        for k in range(order - 1, 0, -1):  # continuation counts: distinct characters before the shorter gram
            g = levels[k + 1][0][:, 1:]
            code = self._code(g)
            _, at, n = np.unique(code, return_index=True, return_counts=True)
            levels[k] = (g[at], n.astype(np.float64))
        alphabet = len(levels[1][0]) + 1
        below: dict = {}
        for k in range(1, order + 1):
            g, n = levels[k]
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = once / (once + 2 * twice) if once + twice else 0.5
            d = min(max(d, 0.1), 0.9)
            ctx = self._code(g[:, :-1]) if k > 1 else np.zeros(len(g), np.uint64)
            unique, owner = np.unique(ctx, return_inverse=True)
            total = np.bincount(owner, n)
            kinds = np.bincount(owner)
            lam = d * kinds / total
            if k == 1:
                lower = np.full(len(g), 1 / alphabet)
            else:
                lower = np.exp(self._get(self.hash[k - 1], self.logp[k - 1], self._code(g[:, 1:]), np.nan))
            p = (n - d) / total[owner] + lam[owner] * lower
            code = self._code(g)
            order_by = np.argsort(code)
            self.hash[k], self.logp[k] = code[order_by], np.log(p[order_by]).astype(np.float32).astype(np.float64)
            self.ctx[k], self.back[k] = unique, np.log(lam)
        self.floor = float(self.back[1][0] + np.log(1 / alphabet))

    @staticmethod
    def _code(g: np.ndarray) -> np.ndarray:
        k = g.shape[1]
        total = np.zeros(len(g), np.uint64)
        for j in range(k):
            total = total * np.uint64(0xD1342543DE82EF95) + g[:, j].astype(np.uint64) + np.uint64(1)
        return mix(total ^ _salt(k))

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of each n-gram's last character after the ones before it."""
        k = self.order
        got = self._get(self.hash[k], self.logp[k], self._code(grams), np.nan)
        weight = np.zeros(len(grams))
        left = np.flatnonzero(np.isnan(got))
        while len(left):
            g = grams[left]
            if k == 1:
                got[left] = weight[left] + self.floor
                break
            # a context not seen at this order has weight 1
            weight[left] += self._get(self.ctx[k], self.back[k], self._code(g[:, self.order - k : -1]), 0.0)
            k -= 1
            lower = self._get(self.hash[k], self.logp[k], self._code(g[:, self.order - k :]), np.nan)
            found = ~np.isnan(lower)
            got[left[found]] = lower[found] + weight[left[found]]
            left = left[~found]
        return got


class Models:
    """All languages' models; ``entropies`` gives the cross-entropies of texts."""

    def __init__(self, models: dict[str, CharModel], order: int):
        self.langs, self.models, self.order = sorted(models), [models[k] for k in sorted(models)], order
        self.limit = np.full(len(self.langs), np.inf)
        self.seen: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": None}

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts × languages mean negative log-probability per character, has_letter)."""
        codes, first, has = characters(column, self.order)
        at = _spots(first, self.order)
        number, unique = pd.factorize(gram_codes(codes, self.order)[at])
        place = np.empty(len(unique), np.int64)
        place[number] = at
        grams = codes[place[:, None] + np.arange(self.order)]
        table = np.stack([m.log_prob(grams) for m in self.models], 1)
        count = np.diff(first) - self.order + 1
        bounds = np.concatenate(([0], np.cumsum(count)))
        out = np.empty((len(column), len(self.langs)))
        for j in range(len(self.langs)):
            c = np.concatenate(([0.0], np.cumsum(table[number, j])))
            out[:, j] = -(c[bounds[1:]] - c[bounds[:-1]]) / count
        return out, has


def learn(docs: DataFrame, order: int = 4, limit_quantile: float = 0.995, margin: float = 0.1, calibrate: int = 16) -> Models | None:
    """Models from all texts of docs(doc_id, text, lang) with a language, but those with crc32(doc_id) mod 4 of 2, and limits
    from those of them that are kept for calibration."""
    known = docs.where(~held_out(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    kept = F.coalesce(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 4) % calibrate == 0, F.lit(False))
    table = count_grams(known.where(~kept), order).toPandas()
    models = {}
    for lang, part in table.groupby("lang"):
        flat = np.frombuffer("".join(part["gram"]).encode("utf-32-le"), "<u4").reshape(-1, order)
        models[lang] = CharModel(np.where(flat == 32, 0, flat), part["n"].to_numpy())
    if not models:  # nothing but calibration texts
        table = count_grams(known, order).toPandas()
        for lang, part in table.groupby("lang"):
            flat = np.frombuffer("".join(part["gram"]).encode("utf-32-le"), "<u4").reshape(-1, order)
            models[lang] = CharModel(np.where(flat == 32, 0, flat), part["n"].to_numpy())
    if not models:
        return None
    out = Models(models, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets, _ = text_buffer(batch.column(0))
            langs = np.asarray(batch.column(1))
            for lo, hi in slices(offsets):
                h, has = out.entropies(batch.column(0).slice(lo, hi - lo))
                own = np.array([out.langs.index(x) if x in out.langs else 0 for x in langs[lo:hi]])
                has &= np.isin(langs[lo:hi].astype(object), out.langs)
                yield pa.record_batch([batch.column(1).slice(lo, hi - lo).filter(pa.array(has)), pa.array(h[np.arange(hi - lo), own][has])], names=["lang", "h"])

    limits = known.where(kept).select("text", "lang").mapInArrow(lean(run), "lang string, h double").groupBy("lang").agg(F.percentile_approx("h", limit_quantile, 10000).alias("q")).collect()
    for r in limits:  # one row a language
        out.limit[out.langs.index(r.lang)] = r.q + margin
    return out


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets, nulls = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                n = hi - lo
                if models is None:
                    lang, score, best, no = np.full(n, "und", object), np.zeros(n), np.zeros(n), np.ones(n, bool)
                else:
                    h, has = models.entropies(batch.column(1).slice(lo, n))
                    has &= ~nulls[lo:hi]
                    pick = h.argmin(1)
                    best = h[np.arange(n), pick]
                    share = 1 / np.exp(-(h - best[:, None]) * 8).sum(1)
                    lang = np.where(has, np.array(models.langs, object)[pick], "und")
                    score = np.where(has, share, 0.0)
                    no = ~has | (best > models.limit[pick])
                    best = np.where(has, best, 0.0)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, n), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(best), pa.array(no)],
                    names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    out = docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
