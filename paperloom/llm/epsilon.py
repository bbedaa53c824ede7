"""Embedding near-duplicates by an epsilon grid order join.

Vectors of a label are normalised; cosine >= c is a distance of at most
eps = sqrt(2 - 2c). Equal vectors are joined as one with a multiplicity. Leading
principal dimensions (of the label-free second moment of all vectors) give each vector its
grid cell of side eps; sorting by cells puts near vectors near each other, and a
principal projection never lengthens a distance, so blocks whose boxes in those
dimensions lie more than eps apart hold no pair.

The sorted sequence is cut into blocks of at most ``block`` rows. Block boxes
meet by their cells in the first two dimensions; pairs of blocks that may hold
links are joined recursively: an interval pair splits in halves until it is
small or provably distant, and what is left is compared by cosines in
double precision; a pair within 1e-12 of the threshold, where unit vectors may round to the other side, is decided by the dot
product of the vectors as they are over the product of their lengths. Each block pair returns its link counts and a spanning forest
of its links, not the links, so dense groups stay linear.

Edge cases: null vectors, zero vectors and vectors with null or non-finite
components, and rows with a null label, link with nothing; vectors of different
length never link; repeated rows link with each other; a null vec_id comes back
alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small
from .components import components

#: Interval pairs of at most so many rows are compared without splitting.
LEAF = 64


def _unit(rows: list | np.ndarray) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def directions(vectors: DataFrame, leading: int) -> dict[int, np.ndarray]:
    """Per vector length, its leading principal directions, from all distinct vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(0).to_pylist()
            dims = np.array([len(r) for r in rows])
            for d in np.unique(dims):
                x = _unit([rows[i] for i in np.flatnonzero(dims == d)])
                total[int(d)] = total.get(int(d), 0) + x.T @ x
        for d, m in total.items():
            yield pa.record_batch([pa.array([d] * (d * d), pa.int32()), pa.array(np.arange(d * d), pa.int32()), pa.array(m.ravel())], names=["dim", "at", "s"])

    out = {}
    for r in vectors.select("v").mapInArrow(run, "dim int, at int, s double").groupBy("dim", "at").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r.dim, np.zeros(r.dim * r.dim))[r.at] = r.s
    found = {}
    for d, m in out.items():
        _, axes = np.linalg.eigh((m.reshape(d, d) + m.reshape(d, d).T) / 2)
        found[d] = axes[:, ::-1][:, :leading].copy()
    return found


def project(vectors: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """rep, label, n, v with dim, order key (grid cells as text), for sorting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(3).to_pylist()
            dims = np.array([len(r) for r in rows])
            key = np.empty(len(rows), object)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                cells = np.floor((_unit([rows[i] for i in mine]) @ axes[int(d)] + 1.5) / eps).astype(int)
                key[mine] = ["".join(f"{c:04d}" for c in row) for row in cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(key, pa.string())], names=[*batch.schema.names, "dim", "cells"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select("rep", "label", "n", "v").mapInArrow(run, f"rep long, label string, n long, v {kind}, dim int, cells string")


def cut(ordered: DataFrame, axes: dict[int, np.ndarray], block: int) -> DataFrame:
    """Blocks of the sorted sequence: label, dim, block, size, ids, ns, m (vectors as doubles), lo, hi (box)."""
    names = ["label", "dim", "block", "size", "ids", "ns", "m", "lo", "hi"]

    def close(held: list[dict], number: int) -> pa.RecordBatch:
        x = np.array([r["v"] for r in held], np.float64)
        z = _unit(x) @ axes[held[0]["dim"]]
        return pa.record_batch(
            [pa.array([held[0]["label"]]), pa.array([held[0]["dim"]], pa.int32()), pa.array([number]), pa.array([len(held)]),
             pa.array([np.array([r["rep"] for r in held], np.int64).tobytes()]), pa.array([np.array([r["n"] for r in held], np.int64).tobytes()]), pa.array([x.tobytes()]),
             pa.array([z.min(0).tolist()]), pa.array([z.max(0).tolist()])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) >= block or (r["label"], r["dim"]) != (held[0]["label"], held[0]["dim"])):
                    yield close(held, number)
                    held, number = [], number + 1
                held.append(r)
        if held:
            yield close(held, number)

    schema = "label string, dim int, block long, size long, ids binary, ns binary, m binary, lo array<double>, hi array<double>"
    return ordered.select("rep", "label", "n", "v", "dim").mapInArrow(run, schema)


def block_pairs(meta: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b, of blocks of one label whose boxes are at most eps apart.

    Boxes meet in the cells of two dimensions that both reach; the pair is kept at its lowest common cell.
    """
    size = 2 * eps

    def reach(side: str, grow: float, j: int) -> list[F.Column]:
        at = lambda end: F.coalesce(F.get(f"{side}{end}", F.lit(j)), F.lit(0.0))  # noqa: E731  a vector may have one component
        return [F.floor((at("lo") - grow) / size), F.floor((at("hi") + grow) / size)]

    def spread(grow: float, name: str) -> DataFrame:
        m = meta.select(*[F.col(c).alias(f"{name}{c}") for c in ("block", "lo", "hi")], "label", "dim")
        for j in (0, 1):
            lo, hi = reach(name, grow, j)
            m = m.withColumn(f"{name}c{j}", lo).withColumn(f"c{j}", F.explode(F.sequence(lo, hi)))
        return m

    a, b = spread(eps, "a"), spread(0.0, "b")
    gap = F.aggregate(
        F.zip_with(
            F.zip_with("alo", "bhi", lambda x, y: F.greatest(x - y, F.lit(0.0))),
            F.zip_with("blo", "ahi", lambda x, y: F.greatest(x - y, F.lit(0.0))),
            lambda p, q: p * p + q * q,
        ), F.lit(0.0), lambda s, x: s + x)
    met = a.join(b, ["label", "dim", "c0", "c1"])
    first = (F.col("c0") == F.greatest("ac0", "bc0")) & (F.col("c1") == F.greatest("ac1", "bc1"))
    return met.where((F.col("ablock") <= F.col("bblock")) & first & (gap <= eps * eps)).select(F.col("ablock").alias("a"), F.col("bblock").alias("b"))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def join(self, a: int, b: int) -> bool:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        while self.up[b] != b:
            self.up[b] = b = self.up[self.up[b]]
        if a == b:
            return False
        self.up[b] = a
        return True


def join_blocks(raw_x: np.ndarray, raw_y: np.ndarray | None, axes: np.ndarray, nx: np.ndarray, ny: np.ndarray, cosine: float, eps: float):
    """Links between two blocks of vectors (raw_y None: within one): weighted counts per row of each, and forest edges (i, j)."""
    same = raw_y is None
    x = _unit(raw_x)
    raw_y, y, far = (raw_x, x, 0) if same else (raw_y, _unit(raw_y), len(x))
    zx, zy = x @ axes, y @ axes
    cx, cy = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    forest, edges = _Forest(len(x) + (0 if same else len(y))), []
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        lo = np.maximum(zx[a:b].min(0) - zy[c:d].max(0), 0)
        hi = np.maximum(zy[c:d].min(0) - zx[a:b].max(0), 0)
        if (lo * lo + hi * hi).sum() > eps * eps:
            continue
        if b - a > LEAF or d - c > LEAF:
            p, q = (a + b) // 2, (c + d) // 2
            if same and (a, b) == (c, d):
                stack += [(a, p, a, p), (a, p, p, b), (p, b, p, b)]
            elif b - a >= d - c:
                stack += [(a, p, c, d), (p, b, c, d)]
            else:
                stack += [(a, b, c, q), (a, b, q, d)]
            continue
        value = x[a:b] @ y[c:d].T
        near = value >= cosine
        for i, j in zip(*np.nonzero(np.abs(value - cosine) < 1e-12), strict=True):
            p, q = raw_x[a + i], raw_y[c + j]
            near[i, j] = (p @ q) / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= cosine
        if same and (a, b) == (c, d):
            np.fill_diagonal(near, False)
            cx[a:b] += near @ nx[a:b]
            near = np.triu(near)
        else:
            cx[a:b] += near @ ny[c:d]
            cy[c:d] += near.T @ nx[a:b]
        for i, j in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
            if forest.join(a + i, far + c + j):
                edges.append((a + i, c + j))
    return (cx + cy, cy * 0, edges) if same else (cx, cy, edges)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, leading: int = 6, block: int = 512, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label)."""
    scratch = scratch or Scratch(vectors.sparkSession, "epsilon")
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    # negative zero equals zero
    clean = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast("float")).otherwise(x))
    fine = (
        F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), clean.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    groups = scratch.store(rows.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "groups")
    axes = directions(groups, leading)
    if not axes:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    n = max(2, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["label", "dim", "cells", "rep"]
    placed = scratch.store(project(groups, axes, eps), "placed")
    blocks = scratch.store(cut(placed.repartitionByRange(n, *order).sortWithinPartitions(*order), axes, block), "blocks")
    pairs = scratch.store(block_pairs(blocks.select("label", "dim", "block", "lo", "hi"), eps), "pairs")
    side = blocks.select("block", "dim", "ids", "ns", "m")
    joined = (
        pairs.join(side.withColumnsRenamed({"block": "a", "ids": "ia", "ns": "na", "m": "ma"}), "a")
        .join(side.drop("dim").withColumnsRenamed({"block": "b", "ids": "ib", "ns": "nb", "m": "mb"}), "b")
        .repartition(n, F.xxhash64("a", "b"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                d = r["dim"]
                ids, ns, m = np.frombuffer(r["ia"], np.int64), np.frombuffer(r["na"], np.int64), np.frombuffer(r["ma"]).reshape(-1, d)
                if r["a"] == r["b"]:
                    other, nb, mb = ids, ns, None
                else:
                    other, nb, mb = np.frombuffer(r["ib"], np.int64), np.frombuffer(r["nb"], np.int64), np.frombuffer(r["mb"]).reshape(-1, d)
                ca, cb, edges = join_blocks(m, mb, axes[d], ns, nb, cosine, eps)
                u = [ids[i] for i, _ in edges]
                v = [other[j] for _, j in edges]
                sa, sb = np.flatnonzero(ca), np.flatnonzero(cb)
                node = np.concatenate((ids[sa], other[sb], np.array(u, np.int64)))
                count = np.concatenate((ca[sa], cb[sb], np.zeros(len(u), np.int64)))
                to = pa.array([None] * (len(sa) + len(sb)) + v, pa.int64())
                yield pa.record_batch([pa.array(node), pa.array(count), to], names=["rep", "links", "to"])

    found = scratch.store(joined.select("a", "b", "dim", "ia", "na", "ma", "ib", "nb", "mb").mapInArrow(run, "rep long, links long, to long"), "found")
    counts = found.where("to is null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = scratch.store(components(found.where("to is not null").select(F.col("rep").alias("u"), F.col("to").alias("v")), scratch), "parts")
    info = scratch.store(
        groups.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "info")
    keyed = rows.withColumn("k", F.when(F.col("fine"), F.xxhash64("label", "v"))).withColumn("kv", F.when(F.col("fine"), F.col("v")))
    there = info.select(F.xxhash64("label", "v").alias("k"), F.col("v").alias("kv"), F.col("label").alias("kl"), "n_links", "component_id")
    # hashes find the row, vector and label confirm it
    out = keyed.join(small(there), ["k"], "left").where(F.col("kl").isNull() | ((keyed.label == F.col("kl")) & (keyed.kv == there.kv)))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
