"""Nested facts, observed metrics and plug-in validators on small rows."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import facts, plugins
from paperloom.operators.observed import Stages


def found(spark, *stores):
    df = spark.createDataFrame(list(enumerate(stores)), "doc_id long, j string").select("doc_id", F.try_parse_json("j").alias("store"))
    return sorted((tuple(r) for r in facts.nested_facts(df, "doc_id", "store").collect()), key=repr)


def test_facts_of_any_depth(spark):
    store = '{"summary": "s", "exp": [{"company": "A", "b": ["x", "", "z"], "t": {"deep": [[1, 2], [{"q": true}]]}}, "loose"], "none": null, "empty": [], "blank": {}}'
    assert found(spark, store) == sorted([
        (0, "summary", "", None, "s"), (0, "exp0.company", "exp0", None, "A"), (0, "exp0.b0", "exp0", 0, "x"), (0, "exp0.b2", "exp0", 2, "z"), (0, "exp1", "", 1, "loose"),
        (0, "exp0.t.deep00", "exp0", 0, "1"), (0, "exp0.t.deep01", "exp0", 1, "2"), (0, "exp0.t.deep10.q", "exp0.t.deep10", None, "true")], key=repr)


def test_facts_of_odd_rows(spark):
    assert found(spark, None, "not json", '"scalar"', "[]", "{}") == []
    assert found(spark, '["a", "b"]', '{"k": "v"}') == [(0, "0", "", 0, "a"), (0, "1", "", 1, "b"), (1, "k", "", None, "v")]
    assert found(spark) == []


def test_stages_are_counted_in_their_own_run(spark):
    passed = spark.sparkContext.accumulator(0)

    def count(x):
        passed.add(1)
        return x

    stages = Stages()
    first = stages.mark(spark.range(100).select(F.udf(count, "long")("id").alias("id")), "all", total=F.sum("id"))
    second = stages.mark(first.where("id % 3 = 0"), "thirds")
    third = stages.mark(second.where("id < 0"), "none", most=F.max("id"))
    assert "CollectMetrics" in third._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        stages.mark(third, "all")
    third.write.format("noop").mode("overwrite").save()
    rows = [tuple(r)[1:] for r in stages.rows(spark).orderBy("place", "metric").collect()]
    assert rows == [("all", "n_rows", 100), ("all", "total", 4950), ("thirds", "n_rows", 34), ("none", "most", None), ("none", "n_rows", 0)]
    assert passed.value == 100


def test_plugins_from_sql(spark):
    rules = [
        plugins.Validator("many", "s", "warn", "over two lines", lambda x: len(x) > 2), plugins.Validator("order", "s", "critical", "not in order", lambda x: list(x) != sorted(x)),
    ]
    plugins.register(spark, "two_rules", rules)
    rows = [(k, p, t) for k, texts in ((1, "abc"), (2, "ba"), (3, "a"), (4, "cab")) for p, t in enumerate(texts)] + [(5, 0, None), (None, 0, "b"), (None, 1, "a")]
    df = spark.createDataFrame(rows, "doc long, pos long, t string").repartition(4)
    got = sorted((tuple(r)[:2] for r in plugins.validate(df, "two_rules", "doc", "pos", "t").collect()), key=repr)
    assert got == sorted([(1, "many"), (2, "order"), (4, "many"), (4, "order"), (None, "order")], key=repr)
    df.createOrReplaceTempView("texts")
    sql = "SELECT rule_id, count(*) AS n FROM two_rules(TABLE(SELECT doc, t, pos FROM texts) PARTITION BY doc ORDER BY pos) GROUP BY rule_id ORDER BY rule_id"
    assert [tuple(r) for r in spark.sql(sql).collect()] == [("many", 2), ("order", 3)]
    assert plugins.validate(df.where("false"), "two_rules", "doc", "pos", "t").collect() == []


def test_plugins_hold_long_groups_of_many_batches(spark):
    plugins.register(spark, "sized", [plugins.Validator(f"n{n}", "s", "warn", "", lambda x, n=n: len(x) == n) for n in (25_000, 3)])
    rows = spark.range(25_003).selectExpr("case when id < 25000 then 1 else 2 end as doc", "id as pos", "'x' as t")
    assert sorted(tuple(r)[:2] for r in plugins.validate(rows, "sized", "doc", "pos", "t").collect()) == [(1, "n25000"), (2, "n3")]
