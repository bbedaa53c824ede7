"""One-to-one assignment against the plain loop, also for one very large group."""

import random

import pytest

from paperloom.operators import assign

SCHEMA = "g long, pos long, title string, company string"


def loop(sources, candidates):
    out = []
    for g in {r[0] for r in sources}:
        left, right = sorted(r[1:] for r in sources if r[0] == g), sorted(r[1:] for r in candidates if r[0] == g)
        used = set()
        for pos, title, company in left:
            hit = None
            if len(right) >= max(1, int(0.75 * len(left))):
                hit = next((c for c, t, firm in right if c not in used and ((company and firm == company) or (title and company and title in t and company in firm))), None)
            used.add(hit)
            out.append((g, pos, hit))
    return sorted(out, key=repr)


def got(spark, sources, candidates):
    df = assign.assign_first_free(spark.createDataFrame(sources, SCHEMA), spark.createDataFrame(candidates, SCHEMA))
    return sorted((tuple(r) for r in df.select("g", "s", "c").collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    firms = ["", "acme", "acmecorp", "corp", "litware", "lit", "northwindtraders", "northwind"]
    titles = ["", "dev", "seniordev", "lead", "leaddev"]
    rows = lambda n: [(g, p, rng.choice(titles), rng.choice(firms)) for g in range(6) for p in rng.sample(range(100), rng.randint(0, n))]
    sources, candidates = rows(14), rows(14)
    assert got(spark, sources, candidates) == loop(sources, candidates)


def test_a_displaced_source_moves_on(spark):
    """The first source asks for the candidate that a later one already holds."""
    sources = [(1, 1, "dev", "acme"), (1, 2, "dev", "acmecorp"), (1, 3, "dev", "corp")]
    candidates = [(1, 1, "dev", "acmecorp"), (1, 2, "dev", "acmecorp"), (1, 3, "dev", "corpo")]
    assert got(spark, sources, candidates) == loop(sources, candidates) == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]


def test_too_few_candidates_reject_the_group(spark):
    sources = [(1, i, "dev", "acme") for i in range(8)] + [(2, 0, "dev", "acme")]
    candidates = [(1, i, "dev", "acme") for i in range(5)]
    assert all(c is None for _, _, c in got(spark, sources, candidates))
    assert sum(c is not None for _, _, c in got(spark, sources, [*candidates, (1, 9, "dev", "acme")])) == 6


def test_a_group_of_100000(spark):
    left = spark.range(100_000).selectExpr("1L as g", "id as pos", "'dev' as title", "concat('firm', id % 3) as company")
    right = spark.range(100_000).where("id % 10 <> 0").selectExpr("1L as g", "id as pos", "'dev' as title", "concat('firm', id % 3) as company")
    df = assign.assign_first_free(left, right)
    a = [r.s for r in df.where("c is null").collect()]
    nth = {f: [i for i in range(100_000) if i % 3 == f and i % 10] for f in range(3)}
    sample = {r.s: r.c for r in df.where("s % 999 = 0").collect()}
    assert len(a) == 10_000 and all(c == (nth[s % 3][s // 3] if s // 3 < len(nth[s % 3]) else None) for s, c in sample.items())


def test_empty_tables(spark):
    assert got(spark, [], []) == [] and got(spark, [(1, 1, "a", "b")], []) == [(1, 1, None)] and got(spark, [], [(1, 1, "a", "b")]) == []


def test_nothing_is_broadcast(spark):
    rows = spark.createDataFrame([(1, 1, "lead", "firma"), (1, 2, "lead", "firma")], SCHEMA)
    more = spark.createDataFrame([(1, 7, "leader", "firmagroup"), (1, 8, "lead", "firma")], SCHEMA)
    got = assign.assign_first_free(rows, more)
    assert {tuple(r) for r in got.collect()} == {(1, 1, 7), (1, 2, 8)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
