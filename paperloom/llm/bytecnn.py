"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded, ``filters`` filters of ``width`` bytes slide over the whole
text in steps of ``stride``, and their rectified responses are max-pooled over
chunks that overlap by half. A linear layer turns a chunk's maxima into
evidence; the mean evidence of a document's chunks gives its probability. The
number of chunks grows with the text, so nothing is cut off.

Training (here, on the driver) uses at most ``train_docs`` labelled documents of
each quality, those with the smallest crc32 of their id among the rows that may
be learnt from; language, source and id are never inputs.

The balanced sample's prior is corrected to that of the labelled rows.

Edge cases: null and empty texts are one chunk of padding with its own score;
repeated rows score alike; without labels of both kinds every score is 1; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import lean, slices, text_buffer
from .linecrf import labelled_sample


class ByteCnn:
    def __init__(self, filters: int = 12, width: int = 8, stride: int = 4, embed: int = 6, half: int = 128, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.width, self.stride, self.embed, self.half = width, stride, embed, half
        self.p = {
            "e": rng.normal(0, 0.5, (256, embed)).astype(np.float32),
            "w": rng.normal(0, (2 / (width * embed)) ** 0.5, (width * embed, filters)).astype(np.float32),
            "b": np.zeros(filters, np.float32),
            "v": rng.normal(0, 0.3, filters).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.p["e"][0] = 0  # padding; the byte 0 counts as padding

    def pad(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts laid out in whole half chunks with padding behind, and each text's first half chunk."""
        unit = self.half * self.stride
        n = np.diff(offsets)
        halves = (n + self.width + unit - 1) // unit
        first = np.concatenate(([0], np.cumsum(halves)))
        out = np.zeros(first[-1] * unit + self.width, np.uint8)
        out[np.arange(len(raw)) + np.repeat(first[:-1] * unit - offsets[:-1], n)] = raw
        return out, first

    def windows(self, x: np.ndarray) -> np.ndarray:
        n = (len(x) // self.embed - self.width) // self.stride
        return np.lib.stride_tricks.as_strided(x, (n, self.width * self.embed), (self.stride * self.embed * 4, 4))

    def across(self) -> int:
        """Windows at a text's end that begin in its padding and reach into the next text; they count as padding."""
        return (self.width - 1) // self.stride

    def halves(self, padded: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each filter's largest rectified response in each half chunk, in steps of bounded memory."""
        unit = self.half * self.stride
        last = np.zeros(first[-1], bool)
        last[first[1:] - 1] = True
        out = []
        for lo in range(0, len(padded) - self.width, unit * 128):
            part = padded[lo : lo + unit * 128 + self.width]
            z = (self.windows(self.p["e"][part].reshape(-1)) @ self.p["w"]).reshape(-1, self.half, len(self.p["b"]))
            z[last[lo // unit : lo // unit + len(z)], self.half - self.across() :] = 0
            out.append(z.max(1))
        return np.maximum(np.concatenate(out) + self.p["b"], 0)

    @staticmethod
    def chunks(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(left, right) half of each chunk: neighbours within a text; a lone half is a chunk."""
        left = np.arange(len(h))
        last = np.zeros(len(h), bool)
        last[first[1:] - 1] = True
        alone = last & np.isin(left, first[:-1])
        left = left[~last | alone]
        return left, np.where(last[left], left, left + 1)

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        padded, first = self.pad(raw, offsets)
        h = self.halves(padded, first)
        a, b = self.chunks(h, first)
        z = np.maximum(h[a], h[b]) @ self.p["v"] + self.p["c"][0]
        owner = np.searchsorted(first, a, side="right") - 1
        return np.bincount(owner, z, len(first) - 1) / np.bincount(owner, minlength=len(first) - 1)

    def step(self, raw: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss."""
        padded, first = self.pad(raw, offsets)
        x = self.p["e"][padded].reshape(-1)
        win = self.windows(x)
        z = (win @ self.p["w"] + self.p["b"]).reshape(-1, self.half, len(self.p["b"]))
        z[first[1:] - 1, self.half - self.across() :] = self.p["b"]
        arg = z.argmax(1)
        top = np.take_along_axis(z, arg[:, None], 1)[:, 0]
        h = np.maximum(top, 0)
        a, b = self.chunks(h, first)
        m = np.maximum(h[a], h[b])
        owner = np.searchsorted(first, a, side="right") - 1
        per = np.bincount(owner, minlength=len(y))
        logit = np.bincount(owner, m @ self.p["v"] + self.p["c"][0], len(y)) / per
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y) / per)[owner].astype(np.float32)
        dm = d[:, None] * self.p["v"]
        dh = np.zeros_like(h)
        use_a = h[a] >= h[b]
        np.add.at(dh, a, np.where(use_a, dm, 0))
        np.add.at(dh, b, np.where(use_a, 0, dm))
        dh[top <= 0] = 0
        half, filt = np.nonzero(dh)
        g = dh[half, filt]
        at = half * self.half + arg[half, filt]
        foreign = np.zeros(len(z) * self.half, bool).reshape(-1, self.half)
        foreign[first[1:] - 1, self.half - self.across() :] = True
        own = ~foreign.reshape(-1)[at]
        seen = win[at] * own[:, None]
        dw = np.zeros_like(self.p["w"])
        for f in range(dw.shape[1]):
            mine = filt == f
            dw[:, f] = g[mine] @ seen[mine]
        de = np.zeros_like(self.p["e"])
        back = ((g * own)[:, None] * self.p["w"].T[filt]).reshape(-1, self.width, self.embed)
        for j in range(self.width):
            np.add.at(de, padded[at * self.stride + j], back[:, j])
        de[0] = 0
        return {"e": de, "w": dw, "b": dh.sum(0), "v": d @ m, "c": np.array([d.sum()], np.float32)}

    def fit(self, texts: list[str], y: list[int], epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 5) -> None:
        """Adam over shuffled batches; the rate falls linearly to 0."""
        rng, mean, square, t = np.random.default_rng(seed), {}, {}, 0
        y = np.array(y, np.float32)
        steps = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                raw, offsets, _ = text_buffer(pa.array([texts[i] for i in pick], pa.large_string()))
                t += 1
                for k, g in self.step(raw, offsets, y[pick]).items():
                    mean[k] = 0.9 * mean.get(k, 0) + 0.1 * g
                    square[k] = 0.99 * square.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (rate * (1 - (t - 1) / steps) * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)


def held_out(doc_id: F.Column, parts: int, rest: int) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int) -> ByteCnn | None:
    """A network from rows whose crc32(doc_id) mod 3 is not 1; None without both qualities."""
    may = ~held_out(F.col("doc_id"), 3, 1)
    texts, marks = labelled_sample(docs, labels, train_docs, may)
    if len(set(marks)) < 2:
        return None
    net = ByteCnn()
    net.fit(texts, marks)
    # the sample is balanced, the labelled rows are not
    good, bad = labels.where(may).agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
    net.p["c"] += np.float32(np.log(good / bad) - np.log(sum(marks) / (len(marks) - sum(marks))))
    return net


def score(docs: DataFrame, net: ByteCnn | None, name: str = "score") -> DataFrame:
    """docs with a column ``name`` (it must be free), the probability of good quality."""
    names = [f.name for f in docs.schema]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets, _ = text_buffer(batch.column(at))
            p = np.ones(batch.num_rows)
            if net is not None:
                for lo, hi in slices(offsets):
                    z = net.logits(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    p[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, name])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields]).add(name, DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = 1200) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text)."""
    net = train(docs, labels, train_docs)
    scored = score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
