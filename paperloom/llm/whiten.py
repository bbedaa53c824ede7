"""Embedding whitening by LOBPCG over distributed covariance products.

Components become longs floor(256 * c). The fit list is each distinct vector once: n vectors with sums S. The
leading eigenvectors of their covariance are found by the locally optimal block
preconditioned conjugate gradient method, without forming the covariance: a pass over the blocks centres the rows, multiplies
them by the residual block and adds the products through a reduction tree. On the driver, which sees (length, block) arrays only,
Rayleigh-Ritz on the span of iterate, residual and previous direction gives the next
iterate. Products of iterate and direction follow from those of their span; before a result is taken, and whenever
the recurrence says that it has converged, the products are formed anew and the residuals of those certify it.

Whitening projects every row (copies too) on the eigenvectors over sqrt(eigenvalue), and one more pass measures
how far the whitened fit list's covariance is from the identity.

Edge cases: rows whose vector is null or has null or non-finite components are dropped; vectors
of each length have a fit list of their own; components beyond the rank of the covariance
(eigenvalue at most 1e-11 of the largest; one vector alone has none) have no rows; a deviation that no long
holds is null; integers that no long holds are the nearest long; repeated rows and null vec_ids have
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean
from .vectors import blocks, by_length, scaled, tree_sum, whole

#: Residuals of certified eigenpairs, relative to the largest eigenvalue; what rounding lets stop short of it must reach LIMIT.
TOLERANCE, LIMIT = 1e-13, 1e-9
#: Eigenvalues at most this share of the largest are beyond the rank.
RANK = 1e-11


def _span(basis: list[np.ndarray], new: np.ndarray, floor: float) -> np.ndarray:
    """Orthonormal directions of new's columns outside an orthonormal basis; those shorter than floor are left out."""
    for _ in range(2):
        for b in basis:
            new = new - b @ (b.T @ new)
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > floor]
    for b in basis:  # what is short is not orthogonal yet
        u = u - b @ (b.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, guard: int = 8, passes: int = 600) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, largest certified residual relative to the largest eigenvalue)
    of the symmetric operator behind product, which multiplies a (dim, block) array in one pass.

    guard: further directions that are iterated, so that the wanted ones part from the rest sooner.
    """
    wanted = min(wanted, dim)
    width = min(dim, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(0).normal(size=(dim, width)))[0]
    best: tuple | None = None
    spent = stale = 0
    while spent < passes and stale < 4:
        # products formed anew: their residuals count
        x = np.linalg.qr(x)[0]
        ax = product(x)
        spent += 1
        e, c = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        e, c = e[::-1], c[:, ::-1]
        x, ax = x @ c, ax @ c
        scale = max(abs(e[0]), np.finfo(float).tiny)
        left = float(np.linalg.norm(ax - x * e, axis=0)[:wanted].max() / scale)
        if best is None or left < best[2]:
            stale = 0 if best is None or left < best[2] / 2 else stale + 1
            best = e[:wanted].copy(), x[:, :wanted].copy(), left
        else:
            stale += 1
        if left <= TOLERANCE or e[0] <= 0:
            break
        p = ap = np.zeros((dim, 0))
        least, idle = left, 0
        while spent < passes:
            r = ax - x * e
            near = np.linalg.norm(r, axis=0)[:wanted].max() / scale
            # what rounding has put into the recurrence stops it: start again from new products
            least, idle = min(near, least), 0 if near < 0.7 * least else idle + 1
            if near <= TOLERANCE / 2 or idle > (3 if near < 1e-11 else 60):
                break
            w = _span([x, p], r / scale, 1e-15)
            if not w.shape[1]:
                break
            aw = product(w)
            spent += 1
            s, a = np.hstack((x, w, p)), np.hstack((ax, aw, ap))
            g = s.T @ a
            e, c = np.linalg.eigh((g + g.T) / 2)
            e, c = e[::-1][:width], c[:, ::-1][:, :width]
            n = x.shape[1]
            step, astep = s[:, n:] @ c[n:], a[:, n:] @ c[n:]
            x, ax = s @ c, a @ c
            # the direction, orthonormal and outside the iterate, with its product
            part = x.T @ step
            step, astep = step - x @ part, astep - ax @ part
            u, size, v = np.linalg.svd(step, full_matrices=False)
            keep = size > 1e-8 * max(size.max(initial=0), 1e-300)
            p, ap = u[:, keep], astep @ (v[keep].T / size[keep])
            if np.linalg.norm(x.T @ x - np.eye(n)) > 1e-10:  # rounding: start again from here
                break
    assert best is not None
    return best


@dataclass
class Whitening:
    """What a fit list of one length gives."""

    n: int
    total: np.ndarray  # sums, Python's integers
    values: np.ndarray
    axes: np.ndarray  # (length, components)
    trace: float
    identity_error: float
    residual: float


def centre(n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole and remaining part, so that centring whole numbers loses nothing to their size."""
    base = np.array([int(s) // n for s in total], np.int64)
    rest = np.array([(int(s) - int(b) * n) / n for s, b in zip(total, base, strict=True)])
    return base, rest


def _centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """(length, rows) columns without their mean, in double precision."""
    return (x - base[:, None]).astype(np.float64) - rest[:, None]


def fit(stored: DataFrame, wanted: int) -> dict[int, Whitening]:
    """The whitening of each length, from the blocks of its distinct vectors."""

    def moments(d: int, x: np.ndarray) -> tuple[int, np.ndarray]:
        return x.shape[1], x.astype(object).sum(1) if x.dtype == object else x.sum(1).astype(object)

    sums = {d: (int(n), s) for d, (n, s) in tree_sum(stored, moments).items() if d}
    means = {d: centre(n, s) for d, (n, s) in sums.items()}
    spread = tree_sum(stored, lambda d, x: ((_centred(x, *means[d]) ** 2).sum(),) if d in means else (0.0,))
    found = {}
    for d, (n, total) in sums.items():
        mine, trace = stored.where(F.col("dim") == d), float(spread[d][0]) / n
        if not trace > 0:
            continue

        def product(y: np.ndarray, d=d, n=n, mine=mine) -> np.ndarray:
            def part(_: int, x: np.ndarray) -> tuple[np.ndarray]:
                z = _centred(x, *means[d])
                return (z @ (z.T @ y),)

            return tree_sum(mine, part)[d][0] / n

        values, axes, residual = lobpcg(product, d, wanted)
        if residual > LIMIT:
            raise ArithmeticError(f"eigenpairs of length {d} are certified to {residual:.1e} only")
        keep = values > RANK * values[0]
        values, axes = values[keep], axes[:, keep]
        axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
        unit = axes / np.sqrt(values)

        def check(_: int, x: np.ndarray, d=d, unit=unit) -> tuple[np.ndarray, np.ndarray]:
            z = unit.T @ _centred(x, *means[d])
            return z.sum(1), z @ z.T

        first, second = tree_sum(mine, check)[d]
        off = second / n - np.outer(first / n, first / n) - np.eye(len(values))
        found[d] = Whitening(n, total, values, axes, trace, float(np.abs(off).max()), residual)
    return found


def _deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sum of (n * x - S)^2 over each row of x (rows, length); None where a long cannot hold it."""
    far = float(np.abs(x).max(initial=0)) * n + max((abs(float(s)) for s in total), default=0.0)
    if x.shape[1] * far * far < 2.0**62:
        gap = x * n - total.astype(np.int64)
        return (gap * gap).sum(1).tolist()
    gap = x.astype(object) * n - total
    return [v if v < 1 << 63 else None for v in (gap * gap).sum(1).tolist()]


def whiten(vectors: DataFrame, components: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual for each whole row of vectors(vec_id, embedding)."""
    scratch = scratch or Scratch(vectors.sparkSession, "whiten")
    rows = vectors.where(whole("embedding")).select("vec_id", scaled("embedding").alias("x"))
    # equal vectors meet as one row a task, so a vector that very many rows hold does not gather
    # written before it is cut into blocks, so that many small parts become few files for the passes to read
    distinct = scratch.store(rows.select("x").distinct(), "distinct")
    fits = fit(blocks(distinct, "x", scratch), components)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, mine, v in by_length(batch.column(1)):
                f = fits.get(d)
                if f is None:
                    continue
                k, m = len(f.values), len(mine)
                z = (f.axes / np.sqrt(f.values)).T @ _centred(np.ascontiguousarray(v.T), *centre(f.n, f.total))
                ids = pa.array(np.tile(mine, k))
                yield pa.record_batch(
                    [batch.column(0).take(ids), pa.array(np.repeat(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(k * m, f.n, np.int64)), pa.array(_deviations(v, f.n, f.total) * k, pa.int64()),
                     pa.array(z.ravel()), pa.array(np.repeat(f.values / f.trace, m)), pa.array(np.full(k * m, f.identity_error)), pa.array(np.full(k * m, f.residual))], names=names)

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double")
