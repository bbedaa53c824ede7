"""Operators on small hand-written tables: tie-breaks, order, edge rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import items
from paperloom.functions import text as T
from paperloom.operators import dedupe, lines as L, matching as M, ranking, rules as R
from paperloom.sources import profiles, tables, word


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [
    ("a, b (c, d); e", ["a", "b (c, d)", "e"]), ("x) , y", ["x)", "y"]), ("", []), (",,a", ["a"]), ("(a, b", ["(a, b"]),
])
def test_split_outside_parens(spark, text, want):
    assert one(spark, T.split_outside_parens(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("work_experience:", "Work Experience"), ("AWS and gcp tools", "AWS and Gcp Tools"), ("the end of it", "The End of It")])
def test_title_case(spark, text, want):
    assert one(spark, T.title_case(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("#abc", "#AABBCC"), ("1a2b3c", "#1A2B3C"), ("zzz", "#000000"), ("", "#000000")])
def test_hex_color(spark, text, want):
    assert one(spark, T.hex_color(F.lit(text))) == want


def test_best_email_prefers_long_local_parts_then_length_then_first(spark):
    text = "me@quite.long.example.com, first.name@a.example.com, other.name@a.example.com"
    assert one(spark, T.best_email(F.lit(text))) == "first.name@a.example.com"
    assert one(spark, T.best_email(F.lit("none"))) is None


def test_phone_patterns_in_order(spark):
    assert one(spark, T.phone(F.lit("2125550100 or +1 (212) 555-0199"))) == "+1 (212) 555-0199"


def test_json_repair(spark):
    reply = '```json\n{"a": {"b": 1}}\n``` thanks'
    assert json.loads(one(spark, T.json_object(F.lit(reply)))) == {"a": {"b": 1}}
    assert one(spark, T.json_object(F.lit("no object"))) is None
    assert one(spark, T.looks_cut_off(F.lit('{"key": "a value that is long enough to count", "b": {')))


def test_month_range_and_trailing_split(spark):
    got = spark.sql("select date'2020-01-05' a, date'2021-03-02' b").select(T.month_range(F.col("a"), F.col("b")).alias("x")).first().x
    assert got == "Jan 2020 - Mar 2021"
    x = one(spark, T.split_trailing(F.lit("Company June 2014"), T.YEAR))
    assert (x.left, x.right) == ("Company June", "2014")


def test_keep_richest_first_of_equals_and_filled_titles(spark):
    rows = [("k", 1, None, 2), ("k", 2, "title", 5), ("k", 3, "other", 5), ("z", 4, "", 1)]
    df = spark.createDataFrame(rows, "key string, pos long, title string, n long")
    got = {r["key"]: (r.pos, r.title, r.n) for r in dedupe.keep_richest(df, "key", F.col("n"), "pos", fill=["title"]).collect()}
    assert got == {"k": (1, "title", 5), "z": (4, None, 1)}


def test_union_priority(spark):
    a = spark.createDataFrame([("x", 2), ("x", 1)], "k string, pos long")
    b = spark.createDataFrame([("x", 0), ("y", 5)], "k string, pos long")
    got = sorted(tuple(r) for r in dedupe.union_priority(a, b, key="k").select("k", "source_rank", "pos").collect())
    assert got == [("x", 0, 1), ("y", 1, 5)]


def test_recency_quota_equals_the_rounds(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.choice([0, 3, 9, 30])) for g in range(12) for i in range(rng.randint(1, 14))]

    def rounds(available, budget, least=6, most=24):
        n = len(available)
        q = [min(most, max(least, round(budget * (n - i) / (n * (n + 1) / 2)))) for i in range(n)]
        while sum(q) > budget and any(x > least for x in q):
            q[max(i for i in range(n) if q[i] > least)] -= 1
        while sum(q) < min(budget, sum(available)):
            before = list(q)
            for i in range(n):
                if q[i] < min(most, available[i]):
                    q[i] += 1
                    if sum(q) >= budget:
                        break
            if q == before:
                break
        return q

    df = spark.createDataFrame(rows, "g long, i long, a long")
    for budget in (30, 70, 160):
        got = {(r.g, r.i): r.quota for r in ranking.recency_quota(df, "g", [F.col("i")], "a", budget).collect()}
        for g in range(12):
            mine = [a for k, _, a in rows if k == g]
            assert [got[g, i] for i in range(len(mine))] == rounds(mine, budget)


def test_line_score_counts_whole_words(spark):
    score = lambda t: one(spark, ranking.line_score(F.lit(t)))
    assert score("Built 3 services with Kafka") == 3 + 2 + 1 + 2.5
    assert score("responsible for rebuilt javascript") == -1
    assert score("Docker") == 2.5


def test_entities_match_by_key_containment_or_tokens(spark):
    left = spark.createDataFrame([("3M",), ("Acme Data Labs",), ("Red Blue",), ("Inc",)], "l string")
    right = spark.createDataFrame([("3m Inc",), ("data labs",), ("blue green white",), ("Acme Labs Works",), ("",)], "r string")
    got = {(r.l, r.r, round(r.share, 3)) for r in M.entity_pairs(left, right).collect()}
    assert got == {("3M", "3m Inc", 1.0), ("Acme Data Labs", "data labs", 1.0), ("Acme Data Labs", "Acme Labs Works", 0.667)}


def test_first_contained_either_way(spark):
    names = spark.createDataFrame([(2, "big ring"), (1, "ring"), (3, "small blue ring set")], "rank long, name string")
    rows = spark.createDataFrame([(1, "a big ring kit"), (2, "blue ring"), (3, "rings"), (4, "")], "k long, t string")
    got = {r.k: r.matched for r in M.first_contained(rows, names, "t", "k").collect()}
    assert got == {1: "ring", 2: "ring", 3: None, 4: None}


def test_contained_rows_or_the_source(spark):
    source = spark.createDataFrame([("State University", "Bachelor of Science"), ("City College", "Master")], "whole string, part string")
    rows = spark.createDataFrame([("state univ.", "x"), ("Elsewhere", "bachelor of science (hons)"), ("Nowhere", "PhD"), ("", "")], "whole string, part string")
    assert {r.whole for r in M.contained_in_source(rows, source, "whole", "part").collect()} == {"state univ.", "Elsewhere"}
    assert {r.whole for r in M.contained_in_source(rows.where("part = 'PhD'"), source, "whole", "part").collect()} == {"State University", "City College"}


def test_sections_and_first_block(spark):
    docs = spark.createDataFrame([(1, "intro\nSkills\na\nOther\nb\nSkills\nc")], "doc_id long, text string")
    got = L.sections(L.lines(docs), F.col("line").isin("Skills", "Other"))
    assert [(r.ln, r.section, r.block) for r in got.orderBy("ln").collect()] == [
        (1, "start", 0), (2, "Skills", 1), (3, "Skills", 1), (4, "Other", 2), (5, "Other", 2), (6, "Skills", 3), (7, "Skills", 3)]
    assert [r.ln for r in L.section_lines(got, F.col("section") == "Skills", all_blocks=False).orderBy("ln").collect()] == [2, 3]


def test_chunks_open_when_a_line_would_pass_the_limit(spark):
    docs = spark.createDataFrame([(1, "aaaa\nbbbb\ncc\ndddddddddddd\ne")], "doc_id long, text string")
    assert [r.chunk for r in L.chunks(L.lines(docs), 8).orderBy("ln").collect()] == [0, 0, 1, 2, 3]


def test_pair_in_order_and_backfill(spark):
    a = spark.createDataFrame([("k", 2), ("k", 1)], "k string, x long")
    b = spark.createDataFrame([("k", 9)], "k string, y long")
    assert sorted((r.x, r.y) for r in M.pair_in_order(a, b, "k", ["x"], ["y"]).collect()) == [(1, 9), (2, None)]
    got = M.backfill(spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("a",), ("b",)], "k string"), "k")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "found"), ("b", "backfilled")]


def test_semi_or_all(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r.k for r in M.semi_or_all(rows, rows.where("k = 'a'"), "k").collect()] == ["a"]
    assert sorted(r.k for r in M.semi_or_all(rows, rows.where("k = 'z'"), "k").collect()) == ["a", "b"]


@pytest.mark.parametrize(("pages", "want"), [(9.0, 5.22), (3.0, 5.0), (12.0, 6.0)])
def test_target_pages(spark, pages, want):
    assert one(spark, ranking.target_pages(F.lit(pages), 5.0)) == want


def test_assembly_order(spark):
    order = spark.createDataFrame([(1, ["b", "x", "b", "a"])], "doc_id long, order array<string>")
    payload = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (1, "c", "C"), (1, "d", "")], "doc_id long, section string, content string")
    got = [r.section for r in ranking.assemble(order, payload, ["c", "d", "a"]).orderBy("pos").collect()]
    assert got == ["b", "a", "c"]


def test_repair_keeps_the_best_draft(spark):
    rule = R.Rule("bad", "body", "critical", "has bad", F.col("text").contains("bad"))
    docs = spark.createDataFrame([(1, "bad text"), (2, "fine")], "doc_id long, text string")
    got = R.repair(docs, [rule], lambda df: df.select("doc_id", F.regexp_replace("text", "bad", "good").alias("text")))
    assert sorted((r.doc_id, r.text, r.score, r.round) for r in got.collect()) == [(1, "good text", 100, 1), (2, "fine", 100, 0)]


def test_docx_round_trip_and_admission(spark, tmp_path):
    items = spark.createDataFrame([(1, 1, "b <two>"), (1, 0, "a & one"), (2, 0, "c")], "doc_id long, pos long, line string")
    for r in word.render(items).collect():
        (tmp_path / f"{r.doc_id}.docx").write_bytes(bytes(r.content))
    (tmp_path / "x.exe").write_bytes(b"no")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "broken.DOCX").write_bytes(b"no zip")
    files = tables.admit_files(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: r.text for r in word.extract(files).collect()}
    assert got == {"1.docx": "a & one\nb <two>", "2.docx": "c", "broken.DOCX": None}


def test_profiles(spark, tmp_path):
    path = str(tmp_path / "profiles")
    rows = [("a", "A", "old", "2020-01-01"), ("b", "B", "x" * 300, "2020-01-02")]
    profiles.save(spark.createDataFrame(rows, "format_id string, name string, text string, saved_at string"), path)
    profiles.save(spark.createDataFrame([("a", "A", "new", "2020-01-03")], "format_id string, name string, text string, saved_at string"), path)
    got = profiles.load(spark, path).collect()
    assert [(r.format_id, len(r.preview)) for r in got] == [("a", 3), ("b", 240)]
    profiles.delete(spark, path, "a", "2020-01-04")
    assert [r.format_id for r in profiles.load(spark, path).collect()] == ["b"]
    with pytest.raises(KeyError):
        profiles.delete(spark, path, "zz", "2020-01-05")


def test_streaming_windows_equal_batch(spark, sf_dir, tmp_path):
    from paperloom.streaming.events import distinct_events, windowed

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windowed(distinct_events(stream, "400 days"), "1 day")
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.window_start, r.event_type, r.n)
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, windowed(events, "1 day").collect()))


@pytest.mark.parametrize(("text", "want"), [
    ('{"a": "a value that is long enough to count", "b": {"c": "x"}}', False), ('{"a": "a value that is long enough to count", "b": {', True),
    ('{"a": "brackets { [ in a string that is long enough"}', False), ('{"a": "an open string with } at its end, long enough }', True), ('{"short": 1}', True),
    ('{"a": ["a value that is long enough to count", "b"]', True), ('{"a": "escaped \\\\" quote { and more of it, long enough"}', False), ('{"a": "a value that is long enough to count"} and', True),
])
def test_cut_off_replies(spark, text, want):
    assert one(spark, T.looks_cut_off(F.lit(text.replace("\\\\", "\\")))) is want


def test_long_strings_do_not_overflow(spark):
    assert one(spark, T.looks_cut_off(F.concat(F.lit('{"a": "'), F.repeat(F.lit("x\\n"), 200_000), F.lit('"}')))) is False


def test_verb_items():
    long = "Built the first service for payments with care and patience over many months. It was used by all teams. Led five people in two towns through the change of tools. They liked it a lot. led on."
    assert items.by_verbs(long) == ["Built the first service for payments with care and patience over many months. It was used by all teams.", "Led five people in two towns through the change of tools. They liked it a lot. led on."]
    assert items.by_verbs("Short text. Built a thing here.") == ["Short text. Built a thing here."]
    assert items.by_verbs("• one item of work • two items of work •  One item, of work! tiny") == ["one item of work", "two items of work", "One item, of work! tiny"]
    assert items.by_verbs("• same item here • Same item: here") == ["same item here"] and items.by_verbs("") == items.by_verbs(None) == []
    assert len(items.by_verbs(" • ".join(f"item number {i} of many" for i in range(30)))) == 20


@pytest.mark.parametrize(("text", "want"), [
    ("['First line of it', \"Second line, which is 'quoted' and long enough\", 'short', 'First line of it']", ["First line of it", "Second line, which is 'quoted' and long enough"]),
    ("One long enough line\n- another line here\n\n• and a third line", ["One long enough line", "another line here", "and a third line"]),
    ("A short one-liner stays whole.", ["A short one-liner stays whole."]), (" ", []), (None, []),
    ("First sentence of it is here. Second sentence is here too! (Third one in marks.) " + "x" * 100, ["First sentence of it is here.", "Second sentence is here too!", "(Third one in marks.) " + "x" * 100]),
    ("\n".join(f"tiny line {i:02d}" for i in range(9)), [" ".join(f"tiny line {i:02d}" for i in range(9))]),
    ("some 'list' of 'debris' here", []),
])
def test_summary_items(text, want):
    assert items.of_summary(text) == want


def test_chunks_carry_over_batches(spark):
    rng = random.Random(7)
    rows = [(d, i + 1, "x" * rng.randint(0, 40)) for d in range(5) for i in range(rng.randint(0, 60))]
    want = []
    for d in range(5):
        chunk, size = 0, 0
        for _, ln, line in [r for r in rows if r[0] == d]:
            if size and size + len(line) > 70:
                chunk, size = chunk + 1, 0
            size += len(line)
            want.append((d, ln, chunk))
    assert sorted(tuple(r) for r in L.chunks(spark.createDataFrame(rows, "doc_id long, ln long, line string").repartition(3), 70).collect()) == want


def test_format_findings(spark):
    docs = spark.createDataFrame([
        (1, "Jane Roe", ["", " "], "Arial", 11.0, None, 0.0), (2, "candidate", ["a@b.org"], " ", 30.0, 9.0, 50.0), (3, None, None, None, None, None, None),
    ], "doc_id long, name string, contacts array<string>, font_family string, font_size_body double, font_size_header double, font_size_name double")
    sections = spark.createDataFrame([
        (1, 1, "summary", "SUMMARY :"), (1, 2, "extra", "Own"), (1, 3, "skills", "Skill Set Overview"), (2, 1, "skills", "Skills"), (2, 2, "summary", None), (2, 3, "skills", ""),
    ], "doc_id long, pos long, section string, title string")
    expected = spark.createDataFrame([("summary", 1, "Summary:", True), ("skills", 2, "Skill set overview", True), ("education", 3, None, False)], "section string, rank long, label string, required boolean")
    got = {}
    for r in R.format_findings(docs, sections, expected).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.severity, r.issue))
    assert 1 not in got
    assert sorted(got[2]) == sorted([
        ("structure", "critical", "Section order mismatch. expected=summary,skills actual=skills,summary,skills"), ("skills", "warn", "Section label 'Skills' differs from format 'Skill set overview'"),
        ("styling", "warn", "font_size_body=30.0 outside sane range 8-16"), ("styling", "warn", "font_size_name=50.0 outside sane range 8-36"), ("styling", "warn", "font_family is missing"),
        ("header", "critical", "Name is missing"), ("header", "warn", "Contact details are in the header")])
    assert sorted(got[3]) == [
        ("header", "critical", "Name is missing"), ("skills", "critical", "Required section 'skills' is missing"), ("styling", "warn", "font_family is missing"),
        ("summary", "critical", "Required section 'summary' is missing")]


def test_shares_of_whole_numbers_are_exact(spark):
    # 0.55 * 180 is more than 99 in double precision; 0.55 * 200 is more than 110
    words = "alpha bravo carbon delta"
    rows = [(n, words.ljust(n, "."), words.ljust(k, ".")) for n, k in ((200, 110), (180, 99), (200, 109))]
    df = spark.createDataFrame(rows, "n long, body string, head string")
    assert [r.c for r in df.select(ranking.covered(F.col("body"), F.col("head")).alias("c")).collect()] == [True, True, False]


def test_means_do_not_depend_on_the_order_of_rows(spark):
    from types import SimpleNamespace

    from paperloom.plans.records import style_profile

    # the mean is 1.85; doubles added in this order fall short of it
    values = [(0, 1.87), (1, 2.91), (2, 1.73), (3, 0.89)]
    for order in (values, values[::-1]):
        data = [(i, 1, "view", v) for i, v in order] + [(9, 2, "view", float("nan"))]
        events = spark.createDataFrame(data, "t long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("t")).coalesce(1)
        got = {r.user_id: r.mean_value for r in style_profile(SimpleNamespace(events=events)).collect()}
        assert got[1] == 1.9 and got[2] != got[2]


def test_means_of_values_with_more_than_ten_decimals_are_not_cut(spark):
    from types import SimpleNamespace

    from paperloom.plans.records import style_profile

    # ten decimals would write 0.05, and 0.1 as its mean
    rows = [(1, 1, "view", 0.04999999999999), (2, 2, "view", 0.05)]
    events = spark.createDataFrame(rows, "t long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.user_id: r.mean_value for r in style_profile(SimpleNamespace(events=events)).collect()} == {1: 0.0, 2: 0.1}
