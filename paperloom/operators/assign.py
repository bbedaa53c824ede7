"""Greedy one-to-one assignment within groups: each source, in order, takes the first free candidate that it may have.

A source may have a candidate of equal company key, or one whose title and company keys contain its own. Because all
candidates prefer earlier sources, the loop's result is the stable matching, which deferred acceptance finds in rounds
of proposals, whatever their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import dropped, written

#: Characters of a company key that a containing key must have.
GRAM = 5


def contained_edges(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """g, s, c of candidates whose title and company contain the source's, for other companies than its own.

    They meet by the first characters of the source's company among the substrings of the candidate's.
    """
    of = lambda rows, t, c: rows.where("title <> '' and company <> ''").select("g", F.col("title").alias(t), F.col("company").alias(c))
    left = of(sources, "ts", "cs").distinct().withColumn("gram", F.substring("cs", 1, GRAM))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: F.when(
        F.length("cc") >= k, F.transform(F.sequence(F.lit(1), F.length("cc") - k + 1), lambda i: F.substring("cc", i, k))).otherwise(F.array().cast("array<string>"))))
    right = of(candidates, "tc", "cc").distinct().withColumn("gram", F.explode(F.array_distinct(spans)))
    kinds = left.join(right.hint("merge"), ["g", "gram"]).where((F.col("cs") != F.col("cc")) & F.contains("tc", "ts") & F.contains("cc", "cs")).select("g", "ts", "cs", "tc", "cc")
    # rows of equal titles and companies meet as one, and only those that match are spread again
    each = lambda rows, t, c, at: rows.select("g", F.col("title").alias(t), F.col("company").alias(c), F.col("pos").alias(at))
    return kinds.join(each(sources, "ts", "cs", "s").hint("merge"), ["g", "ts", "cs"]).join(each(candidates, "tc", "cc", "c").hint("merge"), ["g", "tc", "cc"]).select("g", "s", "c")


def proposals(edges: DataFrame) -> DataFrame:
    """g, s, c: the stable matching over edges(g, s, c), by rounds.

    In a round each free source asks its first candidate that no earlier source holds, and each candidate keeps the earliest that asks or
    holds. Candidates only ever change to earlier sources, so what was refused once stays refused. Every round is a written table, and nothing is broadcast, as the
    driver would hold what is.
    """
    edges = written(edges)
    held = written(edges.select("g", "s", "c").limit(0))
    while True:
        free = edges.join(held.select("g", "s").hint("merge"), ["g", "s"], "left_anti")
        open_ = free.join(held.withColumnRenamed("s", "by").hint("merge"), ["g", "c"], "left").where("by is null or by > s")
        asked = written(open_.groupBy("g", "s").agg(F.min("c").alias("c")))
        if asked.limit(1).count() == 0:
            dropped(asked)
            return held
        last, held = held, written(held.unionByName(asked.select("g", "s", "c")).groupBy("g", "c").agg(F.min("s").alias("s")).select("g", "s", "c"))
        dropped(last, asked)


def assign_first_free(sources: DataFrame, candidates: DataFrame, share: float = 0.75) -> DataFrame:
    """g, s, c for each of sources(g, pos, title, company): the position of its candidate, null if it has none.

    Positions order a group's rows and are unique in it. A group with fewer candidates than ``share`` of its sources (one at least) gets none. Companies whose
    rows no containment touches are matched by rank (the nth source takes the nth candidate), whatever their size; only the others go
    through rounds, with a link for each pair of an equal company among them.
    """
    near = written(contained_edges(sources, candidates))
    touched = near.join(sources.select("g", F.col("pos").alias("s"), "company").hint("merge"), ["g", "s"]).select("g", "company").unionByName(
        near.join(candidates.select("g", F.col("pos").alias("c"), "company").hint("merge"), ["g", "c"]).select("g", "company")).distinct().withColumn("mixed", F.lit(True))

    def sided(rows: DataFrame, name: str) -> DataFrame:
        named = rows.where("company <> ''").join(touched.hint("merge"), ["g", "company"], "left")
        nth = F.row_number().over(W.partitionBy("g", "company").orderBy("pos"))
        return named.select("g", "company", F.col("pos").alias(name), F.coalesce("mixed", F.lit(False)).alias("mixed"), nth.alias("nth"))

    left, right = sided(sources, "s"), sided(candidates, "c")
    plain = left.where("not mixed").join(right.where("not mixed").drop("mixed").hint("merge"), ["g", "company", "nth"]).select("g", "s", "c")
    equal = left.where("mixed").drop("nth").join(right.where("mixed").drop("mixed", "nth").hint("merge"), ["g", "company"]).select("g", "s", "c")
    matched = plain.unionByName(proposals(equal.unionByName(near)))
    n = sources.groupBy("g").agg(F.count(F.lit(1)).alias("n")).join(candidates.groupBy("g").agg(F.count(F.lit(1)).alias("m")).hint("merge"), "g", "left")
    enough = n.where(F.coalesce("m", F.lit(0)) >= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n")))).select("g")
    fair = matched.join(enough.hint("merge"), "g", "left_semi")
    return sources.select("g", F.col("pos").alias("s")).join(fair.hint("merge"), ["g", "s"], "left")
