"""Vector codes and whitening: brute force, nasty rows, ties, repeats, empty tables, clashing columns."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest

from paperloom.llm import partcodes, whiten

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="float"):
    """(vec_id, embedding, label) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2.0, "z") for r in rows], f"vec_id long, embedding array<{kind}>, label int, x int, n double, code string").repartition(3)


def nasty(seed=0, n=150, d=20):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=d))], int(i % 4) if i % 7 else None) for i in range(n)]
    rows += [(n + 1, rows[3][1], 1), (n + 1, rows[3][1], 1), (n + 2, rows[5][1], None), (None, rows[8][1], 2), (None, rows[9][1], 2)]
    rows += [(n + 3, None, 1), (n + 4, [NAN] * d, 1), (n + 5, [INF] + [0.0] * (d - 1), 1), (n + 6, [None] + [0.0] * (d - 1), 1), (n + 7, [-0.0] * d, 1)]
    rows += [(n + 8, [], 1), (n + 9, [0.5, -0.25, 0.1], 3), (n + 10, [0.25, -0.25, 0.1], 3), (n + 11, [7.0], 3)]
    return rows


def whole(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def floor256(v):
    return [(Fraction(x) * 256).__floor__() for x in v]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Everything in Python's integers, row by row."""
    rows = [(i, floor256(v), label) for i, v, label in rows if whole(v)]
    out = []
    for d in {len(v) for _, v, _ in rows}:
        mine = sorted((r for r in rows if len(r[1]) == d), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
        books = [[v[a:b] for _, v, _ in mine[:entries]] for a, b in cut]

        def near(v, p):
            a, b = cut[p]
            return min((sum((x - y) ** 2 for x, y in zip(v[a:b], e, strict=True)), k) for k, e in enumerate(books[p]))

        for _ in range(rounds):
            moved = []
            for p, (a, b) in enumerate(cut):
                members = {}
                for _, v, _ in mine:
                    members.setdefault(near(v, p)[1], []).append(v[a:b])
                moved.append([[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])])
            books = moved
        mark = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for i, v, label in mine:
            found = [near(v, p) for p in range(parts)]
            out.append([i, "".join(f"{k:02x}" for _, k in found), sum(f for f, _ in found), label, mark])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((i, c, e, total[label], m) for i, c, e, label, m in out), key=repr)


def test_codes_equal_brute_force(spark):
    rows = nasty()
    got = partcodes.compress(frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows)


def test_codes_of_large_numbers_use_exact_integers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=16) * 10.0 ** (i % 6)], i % 2) for i in range(90)]
    got = partcodes.compress(frame(spark, rows, "double"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows)
    huge = partcodes.compress(frame(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, 1)])).collect()
    assert len(huge) == 3 and all(r.error >= 0 for r in huge)


def test_nearest_prefers_the_lower_entry():
    book = np.array([[0, 0], [4, 0], [4, 0], [2, 2]])
    entry, far = partcodes.nearest(np.array([[2, 4, 9], [0, 0, 9]]), book)
    assert entry.tolist() == [0, 1, 3] and far.tolist() == [4, 0, 98]


def test_mean_is_floored_below_zero_too(spark):
    rows = [(1, [-1 / 256], 0), (2, [-2 / 256], 0)] + [(3 + i, [-1 / 256], 0) for i in range(2)]
    got = partcodes.compress(frame(spark, rows, "double"), parts=1, entries=1, rounds=1).collect()
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(b"-2").hexdigest()}  # floor(-5 / 4)


@pytest.mark.parametrize("operator", [partcodes.compress, whiten.whiten])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).collect() == []
    assert operator(frame(spark, [(1, None, 1), (2, [NAN, 1.0], None)])).collect() == []


def plain_whitening(rows, k=4):
    """By the whole covariance of the distinct vectors, for one length."""
    x = np.array([floor256(v) for v in rows], np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    z = u - s / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_equals_the_whole_covariance(spark):
    rows = [r for r in nasty(4, 200, 24) if not whole(r[1]) or len(r[1]) == 24]
    got = whiten.whiten(frame(spark, rows))
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    kept = [r for r in rows if whole(r[1])]
    n, deviation, z, explained = plain_whitening([v for _, v, _ in kept])
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    for c in range(4):
        mine = sorted(((r.vec_id, r.deviation, r.whitened) for r in got if r.component == c + 1), key=repr)
        sides = [sorted(((i, int(d), s * w) for (i, _, _), d, w in zip(kept, deviation, z[:, c], strict=True)), key=lambda r: repr(r[:2])) for s in (1, -1)]
        assert [r[:2] for r in sorted(mine, key=lambda r: repr(r[:2]))] == [r[:2] for r in sides[0]]
        assert min(max(abs(a[2] - b[2]) for a, b in zip(sorted(mine, key=lambda r: repr(r[:2])), side, strict=True)) for side in sides) < 1e-8
        assert abs(next(r.explained for r in got if r.component == c + 1) / explained[c] - 1) < 1e-9


def test_components_beyond_the_rank_have_no_rows(spark):
    few = [(i, [float(i), 2.0 * i, 1.0, 5.0, 0.0, 0.0, 0.0, 0.0], 0) for i in range(9)]  # rank 1
    got = whiten.whiten(frame(spark, few)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and got[0].explained == pytest.approx(1)
    assert whiten.whiten(frame(spark, [(1, [1.0, 2.0], 0)] * 5)).collect() == []  # one distinct vector
    short = whiten.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 1.0], 0), (3, [0.0, 0.5], 0)])).collect()
    assert {r.component for r in short} == {1, 2} and len(short) == 6


def test_lengths_have_fit_lists_of_their_own_and_large_means_lose_nothing(spark):
    rng = np.random.default_rng(5)
    near = [[float(v) for v in 1e9 + rng.integers(-50, 50, 6)] for _ in range(60)]
    other = [[float(v) for v in rng.normal(size=5)] for _ in range(40)]
    got = whiten.whiten(frame(spark, [(i, v, 0) for i, v in enumerate(near + other)], "double")).collect()
    for low, block in ((0, near), (60, other)):
        n, deviation, z, _ = plain_whitening(block)
        mine = [r for r in got if low <= r.vec_id < low + len(block)]
        assert {r.n for r in mine} == {n} and sorted({(r.vec_id, r.deviation) for r in mine}) == [(low + i, int(d)) for i, d in enumerate(deviation)]
        first = np.array([r.whitened for r in sorted(mine, key=lambda r: r.vec_id) if r.component == 1])
        assert min(np.abs(first - z[:, 0]).max(), np.abs(first + z[:, 0]).max()) < 1e-6


def test_lobpcg_certifies_close_and_equal_eigenvalues():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    for top in ([5, 4.999, 4.998, 4.997, 4.996], [3, 3, 3, 3, 3, 3, 3], [1e6, 1, 1e-2, 1e-3], [1, 0.977, 0.641, 0.634, 0.632, 0.63, 0.628, 0.626, 0.625]):
        e = np.concatenate((top, np.linspace(min(top) * 0.9, 0, 60 - len(top))))
        v = q * e @ q.T
        passes = []
        values, axes, left = whiten.lobpcg(lambda y, v=v, passes=passes: passes.append(1) or v @ y, 60, 4)
        assert len(passes) < 120 and left <= whiten.LIMIT and np.allclose(values, e[:4], rtol=1e-9, atol=1e-12 * e[0])
        assert np.linalg.norm(axes.T @ axes - np.eye(4)) < 1e-12
