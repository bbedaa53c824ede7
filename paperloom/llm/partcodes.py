"""Vector code compression: codebooks per part of the vectors, fitted by treeAggregate over columnar blocks.

Components become integers floor(256 * x). A vector is cut into ``parts`` equal
consecutive parts; each part position has a codebook of up to ``entries`` integer
entries, which starts as that part of the smallest vec_ids' vectors. A round gives each
part its nearest entry: squared distances to all entries accumulate dimension by dimension over a block's
columns. np.add.at puts the parts into int64 sum and count tensors, which merge through the reduction tree
of RDD.treeAggregate; each entry then becomes the floor of its mean. Unused entries stay.
A code has two hex digits a part.

Every row is coded; what the driver sees are sums of the size of the codebooks.

Edge cases: rows whose vector is null or has null or non-finite components are dropped;
vectors of another length have codebooks of their own; a length that ``parts`` does not divide is
cut as evenly as whole components allow, and a part without components has distance 0; with fewer vectors than entries the codebooks are
shorter; equal vec_ids are ordered by their vectors, null vec_ids come last; integers that no long holds are
the nearest long, and so are errors; null labels count as one label; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, small
from .vectors import NARROW, blocks, by_length, scaled, tree_sum, whole

_TOP = (1 << 63) - 1


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """The consecutive parts of a vector."""
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each column of x (dims, rows) against book (entries, dims); ties go to the lower entry."""
    kind = object if object in (x.dtype, book.dtype) else np.int64
    far = np.zeros((x.shape[1], len(book)), kind)
    for j in range(len(x)):
        gap = x[j][:, None] - book[:, j]
        far += gap * gap
    entry = far.argmin(1)
    return entry, far[np.arange(len(entry)), entry]


def _first(rows: DataFrame, entries: int) -> dict[int, np.ndarray]:
    """Per length, the vectors of the smallest vec_ids as (entries, length)."""
    found = {}
    for d in sorted(r.d for r in rows.select(F.size("x").alias("d")).distinct().collect()):
        chosen = rows.where(F.size("x") == d).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
        found[d] = _kind(np.array([r.x for r in chosen], np.int64).reshape(len(chosen), d))
    return found


def _kind(x: np.ndarray) -> np.ndarray:
    """The entries as int64 where squares of differences cannot overflow, as Python's integers otherwise."""
    wide = any(abs(v) > NARROW for v in (x.min(initial=0), x.max(initial=0)))
    return x.astype(object if wide else np.int64)


def fit(stored: DataFrame, books: dict[int, np.ndarray], parts: int, rounds: int) -> dict[int, np.ndarray]:
    """The codebooks, (entries, length) for each length, after so many rounds over all blocks."""
    sc = stored.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast(books)

        def part(d: int, x: np.ndarray, sent=sent) -> tuple[np.ndarray, np.ndarray]:
            book = sent.value[d]
            sums, counts = np.zeros(book.shape, x.dtype), np.zeros((parts, len(book)), np.int64)
            for p, (a, b) in enumerate(bounds(d, parts)):
                entry, _ = nearest(x[a:b], book[:, a:b])
                np.add.at(sums[:, a:b], entry, x[a:b].T)
                np.add.at(counts[p], entry, 1)
            return sums, counts

        moved = {}
        for d, (sums, counts) in tree_sum(stored, part).items():
            book = books[d].astype(object)
            for p, (a, b) in enumerate(bounds(d, parts)):
                used = np.flatnonzero(counts[p])
                book[used, a:b] = sums[used, a:b].astype(object) // counts[p][used].astype(object)[:, None]
            moved[d] = _kind(book)
        sent.destroy()
        books = moved
    return books


def digest(book: np.ndarray, parts: int) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    values = [str(int(v)) for a, b in bounds(book.shape[1], parts) for v in book[:, a:b].ravel()]
    return hashlib.sha256(",".join(values).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each whole row of vectors(vec_id, embedding, label)."""
    scratch = scratch or Scratch(vectors.sparkSession, "partcodes")
    rows = vectors.where(whole("embedding")).select("vec_id", "label", scaled("embedding").alias("x"))
    books = _first(rows, entries)
    if books:
        books = fit(blocks(rows, "x", scratch), books, parts, rounds)
    marks = {d: digest(b, parts) for d, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code, error, mark = np.zeros((n, parts), np.uint8), np.zeros(n, object), np.empty(n, object)
            for d, mine, v in by_length(batch.column(2)):
                x = _kind(np.ascontiguousarray(v.T))
                for p, (a, b) in enumerate(bounds(d, parts)):
                    entry, far = nearest(x[a:b], books[d][:, a:b])
                    code[mine, p] = entry
                    error[mine] += far
                mark[mine] = marks[d]
            text = [r.tobytes().hex() for r in code]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([min(int(e), _TOP) for e in error], pa.int64()), pa.array(mark, pa.string())],
                names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = rows.mapInArrow(lean(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string")
    coded = scratch.store(coded, "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_TOP).cast("decimal(38,0)")).cast("long")
    by_label = scratch.store(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "by_label")
    return coded.join(small(by_label), coded.label.eqNullSafe(by_label["of"])).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
