"""Greedy near-duplicate choice: the fold, the rounds over a table, and the classes, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import dedupe, greedy, ranking

SCHEMA = "id long, tokens array<string>, signals array<string>, themes array<string>, size long, score double"
FEATURES = ("tokens", "signals", "themes")


def near(a, b):
    """The relation, said again."""
    ta, tb, sa, sb = set(a[1]), set(b[1]), set(a[2]), set(b[2])
    if not ta or not tb:
        return False
    common, share, both = len(ta & tb), len(ta & tb) / len(ta | tb), len(sa & sb)
    return share >= 0.58 or (common >= 5 and share >= 0.42) or (both >= 2 and share >= 0.28) or (sa == sb and len(sa) >= 2 and share >= 0.18) or bool(set(a[3]) & set(b[3]))


def fold(rows):
    """{id: (slot, kept)} of a plain loop in order."""
    kept, slot = [], {}
    for r in rows:
        at = next((i for i, k in enumerate(kept) if near(k[1], r)), None)
        if at is None:
            kept.append((r[0], r))
            slot[r[0]] = r[0]
            continue
        old = kept[at][1]
        slot[r[0]] = kept[at][0]
        if r[5] > old[5] or (r[4] > old[4] + 20 and r[5] >= old[5] - 0.5):
            kept[at] = (kept[at][0], r)
    held = {k[1][0] for k in kept}
    return {r[0]: (slot[r[0]], r[0] in held) for r in rows}


def with_copies(rows):
    """The loop over first rows of equal features; others go with them."""
    first = {}
    for r in rows:
        first.setdefault((tuple(sorted(r[1])), tuple(sorted(r[2])), r[4], r[5]) if r[1] else r[0], r)
    chosen = fold(list(first.values()))
    lead = {r[0]: first[(tuple(sorted(r[1])), tuple(sorted(r[2])), r[4], r[5]) if r[1] else r[0]][0] for r in rows}
    return {i: (chosen[f][0], chosen[f][1] and i == f) for i, f in lead.items()}


def items(seed, n, vocabulary, most, scores):
    rng = random.Random(seed)
    words, signals = [f"t{i}" for i in range(vocabulary)], ["java", "spark", "redis", "kafka"]
    return [
        (i, sorted(rng.sample(words, rng.randint(0, most))), sorted(rng.sample(signals, rng.choice([0, 0, 0, 1, 2, 3]))), ["access:react"] if rng.random() < 0.03 else [], rng.randint(25, 90), rng.choice(scores))
        for i in range(n)
    ]


def chosen(df):
    return {r.id: (r.slot, r.kept) for r in greedy.choose(df).collect()}


@pytest.mark.parametrize(("seed", "n", "vocabulary", "most", "scores"), [
    (1, 60, 14, 9, [0.0, 0.4, 1.0, 3.0]), (2, 120, 40, 8, [0.0, 0.5, 1.0]), (3, 80, 9, 6, [1.0]), (4, 50, 5, 4, [float(i) for i in range(40)]),
])
def test_rounds_equal_the_loop(spark, seed, n, vocabulary, most, scores):
    rows = items(seed, n, vocabulary, most, scores)
    assert chosen(spark.createDataFrame(rows, SCHEMA).repartition(3)) == with_copies(rows)


def test_a_chain_of_better_items_hands_its_slot_on(spark):
    """Each is near its neighbours only, and the slot moves along: the slowest case."""
    rows = [(i, [f"t{i}", f"t{i + 1}", f"t{i + 2}", f"t{i + 3}"], [], [], 30, float(i)) for i in range(8)]
    assert chosen(spark.createDataFrame(rows, SCHEMA)) == with_copies(rows)


def test_copies_go_with_the_first_and_items_without_tokens_stay(spark):
    rows = [(i, ["aaa", "bbb", "ccc"], [], [], 40, 1.0) for i in range(200)] + [(200, [], [], [], 30, 0.0), (201, [], [], [], 30, 0.0), (202, ["aaa", "bbb", "ccc"], [], [], 99, 0.6)]
    got = chosen(spark.createDataFrame(rows, SCHEMA))
    assert got == with_copies(rows)
    assert got[202] == (0, True) and got[0] == (0, False) and got[200] == (200, True) and not any(got[i][1] for i in range(1, 200))
    assert chosen(spark.createDataFrame([], SCHEMA)) == {}


def test_a_large_near_group_takes_few_rounds(spark, monkeypatch):
    from paperloom.operators import greedy as module

    rng = random.Random(9)
    rows = [(i, sorted(["common"] * 0 + [f"t{j}" for j in range(20)] + [f"own{i}"]), [], [], 50, rng.random()) for i in range(150)]
    count = []
    plain = module.written
    monkeypatch.setattr(module, "written", lambda df: count.append(1) or plain(df))
    assert chosen(spark.createDataFrame(rows, SCHEMA)) == with_copies(rows)
    assert len(count) < 40  # two a round; 150 one by one would be 300


def test_groups_are_folded_in_order(spark):
    rows = [(g, *r) for g in (1, 2, 3) for r in items(10 + g, 25, 14, 9, [0.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "g long, pos long, " + SCHEMA.removeprefix("id long, "))
    got = {}
    for r in greedy.collapse_groups(df, "g").collect():
        got.setdefault(r.g, set()).add(r.pos)
    assert got == {g: {i for i, (_, kept) in fold([r[1:] for r in rows if r[0] == g]).items() if kept} for g in (1, 2, 3)}


def kept_lines(spark, lines):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, pos long, line string")
    got = greedy.collapse_groups(greedy.featured(df, F.col("line"), ranking.line_score(F.col("line")), "doc_id", "pos"), "doc_id")
    return [lines[r.pos] for r in got.orderBy("pos").collect()]


def test_rewritten_lines_collapse_and_the_distinct_one_stays(spark):
    lines = [
        "Developed WCAG 2.1 compliant web applications using Angular and TypeScript.",
        "Built accessibility compliant Angular interfaces following WCAG 2.1 standards.",
        "Implemented WCAG accessibility standards in Angular front end modules.",
        "Migrated payment batch jobs from Oracle to PostgreSQL, cutting run time by 40%.",
    ]
    got = kept_lines(spark, lines)
    assert len(got) == 2 and lines[3] in got


def test_themes(spark):
    def keys(words):
        return spark.createDataFrame([(words,)], "t array<string>").select(greedy.theme_keys(F.col("t")).alias("k")).first().k

    assert keys(["wcag", "react", "vue"]) == ["access:react", "access:vue"]
    assert keys(["mulesoft", "munit", "raml"]) == ["integration:test"]
    assert keys(["raml"]) == ["integration:integration"] and keys(["mulesoft"]) == [] and keys(["react"]) == [] and keys([]) == []


def test_overlap_tokens_lose_marks_suffixes_and_filler(spark):
    df = spark.createDataFrame([("Using React.js, node.js- and C++ with the Team; a.b.c ++ TypeScript-",)], "t string")
    assert df.select(greedy.overlap_tokens(F.col("t")).alias("x")).first().x == ["react", "node", "typescript"]


def test_classes_count_links_without_pairs(spark):
    a, b, c = ["x1", "x2", "x3", "x4", "x5"], ["x1", "x2", "x3", "x4", "x6"], ["x1", "x2", "x3", "x6", "x7"]
    rows = [(5, a), (3, a), (9, b), (1, c), (7, ["solo"]), (8, []), (4, [])]
    got = {r.id: (r.class_id, r.n_links) for r in dedupe.near_classes(spark.createDataFrame(rows, "id long, tokens array<string>"), 0.58).collect()}
    # a-b: 4/6, b-c: 4/6, a-c: 3/7
    assert got == {5: (1, 2), 3: (1, 2), 9: (1, 3), 1: (1, 1), 7: (7, 0), 8: (8, 0), 4: (4, 0)}


def test_pairs_in_slices_equal_brute_force(spark, monkeypatch):
    import random

    draw = random.Random(3)
    base = [draw.sample(range(60), draw.randint(1, 40)) for _ in range(12)]
    sets = [[f"t{x}" for x in {*b, *draw.sample(range(60), draw.randint(0, 12))} - set(draw.sample(b, draw.randint(0, len(b) // 3)))] for b in base for _ in range(8)]
    sets += [sets[0], sets[0], sets[5], [], []]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    rounds = []
    monkeypatch.setattr(dedupe, "round", lambda x: rounds.append(x) or 3, raising=False)
    for t in (0.58, 0.42, 0.18):
        want = set()
        for i, a in enumerate(sets):
            for j in range(i + 1, len(sets)):
                common, total = len({*a} & {*sets[j]}), len({*a} | {*sets[j]})
                if common and 100 * common >= round(100 * t) * total:
                    want.add((i, j, common, total))
        assert {tuple(r) for r in dedupe.shared_token_pairs(df, t).collect()} == want
        assert sorted(tuple(r) for r in dedupe.near_pairs(df, t).collect()) == sorted(want)
    assert len(rounds) == 12


def test_components_are_folded_and_large_ones_take_rounds(spark, monkeypatch):
    """A chain that hands its slot on takes no rounds when it is folded: before, two tables a round."""
    count, plain = [], greedy.written
    monkeypatch.setattr(greedy, "written", lambda df: count.append(1) or plain(df))
    chain = [(i, [f"t{i}", f"t{i + 1}", f"t{i + 2}", f"t{i + 3}"], [], [], 30, float(i)) for i in range(8)]
    rows = chain + [(100 + r[0], *r[1:]) for r in items(5, 40, 12, 7, [0.0, 0.5, 1.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    assert chosen(df) == with_copies(rows) and len(count) <= 5
    monkeypatch.setattr(greedy, "FOLDED", 9)
    assert chosen(df) == with_copies(rows) and len(count) > 10


def test_blocks_equal_brute_force(spark, monkeypatch):
    """Sets of many sizes in many blocks; counts above 255, and tokens frequent and rare."""
    from paperloom.operators import overlap

    draw = random.Random(4)
    base = [draw.sample(range(3000), n) for n in (1, 2, 3, 9, 40, 41, 60, 90, 700)]
    sets = [[f"t{x}" for x in {*b[: draw.randint((len(b) + 1) // 2, len(b))], *draw.sample(range(3000), draw.randint(0, len(b) // 3))}] for b in base for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    for name, value in (("BLOCK", 5_000), ("COPIES", 2), ("FREQUENT", 50)):
        monkeypatch.setattr(dedupe, name, value)
    monkeypatch.setattr(overlap, "MEET", 100)
    for t in (0.58, 0.18):
        want = set()
        for i, a in enumerate(sets):
            for j in range(i + 1, len(sets)):
                common, total = len({*a} & {*sets[j]}), len({*a} | {*sets[j]})
                if common and 100 * common >= round(100 * t) * total:
                    want.add((i, j, common, total))
        assert sorted(tuple(r) for r in dedupe.shared_token_pairs(df, t).collect()) == sorted(want)
