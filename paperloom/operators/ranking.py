"""Scores, quotas, ordered assembly and caps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

#: Words that raise a line's score (fixed values): verbs of work, common technologies, and words of high signal.
VERBS = ("led", "architected", "designed", "implemented", "developed", "optimized", "delivered", "built", "engineered")
TECHNOLOGIES = ("aws", "azure", "kafka", "kubernetes", "spring", "microservices", "react", "angular", "python", "java")
SIGNALS = (
    "mulesoft", "camp", "forge", "bedrock", "oauth", "graphql", "terraform", "eks", "fargate", "databricks", "anypoint", "raml", "dataweave", "wcag", "openai", "langgraph",
    "langchain", "aws", "azure", "kafka", "kubernetes", "spring", "microservices", "react", "angular", "python", "java", "docker", "jenkins", "salesforce", "snowflake",
    "redshift", "dynamodb", "postgres", "mongodb", "spark", "flink", "airflow", "redis", "elasticsearch", "rabbitmq", "grpc", "webpack", "nextjs",
)


def any_word(words: Sequence[str]) -> str:
    """Pattern of lower-case text that has one of the words, whole."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})([^\p{{L}}\p{{N}}_]|$)"


def line_score(line: Column, verbs: Sequence[str] = VERBS, technologies: Sequence[str] = TECHNOLOGIES, signals: Sequence[str] = SIGNALS) -> Column:
    """3 for a digit, 2 for a verb, 1 for a technology, 2.5 for a word of high signal, 2 for 80 to 280 characters (0.5 above), -1 for filler."""
    n, low = F.length(line), F.lower(line)
    score = F.when(line.rlike("[0-9]"), 3.0).otherwise(0.0) + F.when(n.between(80, 280), 2.0).when(n > 280, 0.5).otherwise(0.0)
    own = F.split(low, r"[^\p{L}\p{N}_]+")  # words once, then sets: no alternation is tried at every character
    for words, points in ((verbs, 2.0), (technologies, 1.0), (signals, 2.5)):
        if words:
            score = score + F.when(F.arrays_overlap(own, F.array(*[F.lit(w) for w in words])), points).otherwise(0.0)
    return score - F.when(low.contains("responsible for") | low.contains("worked on"), 1.0).otherwise(0.0)


def top_k(df: DataFrame, group: Sequence[str], k: Column | int, order: Sequence[Column]) -> DataFrame:
    """The k first rows of each group by order, with their rank."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def recency_caps(rank: Column) -> Column:
    """Caps by recency rank from 0: 12, 11, 10 to the third, 8 to the fifth, then 6."""
    return F.when(rank <= 0, 12).when(rank == 1, 11).when(rank <= 3, 10).when(rank <= 5, 8).otherwise(6).cast("long")


def recency_quota(df: DataFrame, group: str, order: Sequence[Column], available: str, budget: int, least: int = 6, most: int = 24) -> DataFrame:
    """Adds each row's share of a group's budget, weighed by recency (n for the newest, 1 for the oldest), rounded half to
    even and clamped, then balanced: what is above the budget is taken back from the oldest rows first, down to ``least``; what is
    below it, and available, is dealt out one at a time, newest first, up to ``most`` and to what the row has."""
    w = W.partitionBy(group)
    along = w.orderBy("rank")
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))
    weight = F.col("_n") - F.col("rank") + 1
    total = F.col("_n") * (F.col("_n") + 1) / 2
    share = F.least(F.lit(most).cast("long"), F.greatest(F.lit(least).cast("long"), F.bround(budget * weight / total).cast("long")))
    spare = F.col("_q") - least
    older = F.coalesce(F.sum("_spare").over(along.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    cut = (
        ranked.withColumn("_q", share).withColumn("_spare", spare)
        .withColumn("_back", F.sum("_q").over(w) - budget - older)
        .withColumn("_q", F.col("_q") - F.greatest(F.lit(0), F.least(F.col("_back"), F.col("_spare"))))
        .withColumn("_sum", F.sum("_q").over(w))
        .withColumn("_goal", F.least(F.lit(budget), F.sum(available).over(w)))
        .withColumn("_room", F.least(F.lit(most), F.col(available)) - F.col("_q"))
    )
    # rounds of one seat a row: after k of them min(room, k) are dealt; how many rounds there are, and where the last one ends, follows from those sums
    room, total = F.greatest(F.col("_room"), F.lit(0)), F.col("_sum")
    dealt = F.array(*[F.sum(F.least(room, F.lit(k))).over(w) for k in range(1, most - least + 1)])
    begun = F.size(F.filter(F.concat(F.array(F.lit(0).cast("long")), F.slice("_dealt", 1, most - least - 1)), lambda x: total + x < F.col("_goal")))
    upto = lambda k: F.when(k > 0, F.element_at("_dealt", F.greatest(k, F.lit(1)))).otherwise(0)
    level = (
        cut.withColumn("_dealt", F.transform(dealt, lambda x: x.cast("long")))
        .withColumn("_seats", F.least(F.greatest(F.lit(budget) - total, F.lit(0)), upto(begun)))
        .withColumn("_full", F.size(F.filter("_dealt", lambda x: x <= F.col("_seats"))))
        .withColumn("_left", F.col("_seats") - upto(F.col("_full")))
        .withColumn("_above", room > F.col("_full"))
        .withColumn("_turn", F.sum(F.col("_above").cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    )
    last = (F.col("_above") & (F.col("_turn") <= F.col("_left"))).cast("long")
    return level.select(*df.columns, "rank", (F.col("_q") + F.least(room, F.col("_full")) + last).cast("long").alias("quota"))


def with_must_keep(lines: DataFrame, quota: int, score: Column, must: Column) -> DataFrame:
    """Up to ``quota`` lines of each document: those that must stay first, then by score; returned in original order."""
    w = W.partitionBy("doc_id").orderBy(must.cast("int").desc(), score.desc(), "ln")
    return lines.withColumns({"score": score, "must_keep": must}).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= quota)


def in_order(df: DataFrame, ranks: DataFrame, name: str, default: int = 999) -> DataFrame:
    """Adds ``place`` from ranks(name, rank); unknown names come last."""
    return df.join(F.broadcast(ranks), name, "left").withColumn("place", F.coalesce("rank", F.lit(default).cast("long"))).drop("rank")


def assemble(order: DataFrame, payload: DataFrame, core: Sequence[str]) -> DataFrame:
    """doc_id, pos, section, content: requested sections (doc_id, order array), first mention wins, then missing core
    sections in fixed order; sections without content are left out."""
    tail = F.array(*[F.lit(c) for c in core])
    listed = order.select("doc_id", F.posexplode(F.array_distinct(F.concat("order", tail))).alias("pos", "section"))
    return listed.withColumn("pos", (F.col("pos") + 1).cast("long")).join(payload.where("content <> ''"), ["doc_id", "section"]).select("doc_id", "pos", "section", "content")


def capped(df: DataFrame, caps: Mapping[str, int], kind: str, order: Sequence[Column], group: Sequence[str]) -> DataFrame:
    """Rows within their kind's cap in each group; kinds without a cap pass whole."""
    cap = F.lit(None).cast("long")
    for k, n in caps.items():
        cap = F.when(F.col(kind) == k, F.lit(n).cast("long")).otherwise(cap)
    w = W.partitionBy(*group, kind).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(cap.isNull() | (F.col("rank") <= cap))


def pages(lines: DataFrame, per_page: int = 3000, base: int = 450) -> DataFrame:
    """doc_id, chars, pages, target: line lengths clamped to 60..320 over a page's characters; the target shrinks long ones."""
    chars = F.sum(F.least(F.greatest(F.length("line"), F.lit(60)), F.lit(320))) + base
    got = lines.groupBy("doc_id").agg(chars.cast("long").alias("chars")).withColumn("pages", F.greatest(F.lit(0.5), F.col("chars") / per_page))
    return got.withColumn("target", target_pages(F.col("pages"), 5.0))


def target_pages(pages: Column, configured: float) -> Column:
    """max(4, configured) if the pages fit it (with 0.2 to spare), else 58% of them between configured and 6, half to even."""
    return F.when(pages <= configured + 0.2, F.lit(max(4.0, configured))).otherwise(F.bround(F.least(F.lit(6.0), F.greatest(F.lit(configured), 0.58 * pages)), 2))


def covered(text: Column, other: Column, share: float = 0.45, least: int = 3) -> Column:
    """Whether ``other`` keeps the detail of ``text``: enough characters and enough of its content tokens."""
    from .matching import content_tokens

    mine = content_tokens(text)
    hits = F.size(F.array_intersect(mine, content_tokens(other)))
    return (F.length(other) >= 80) & (F.length(other) >= T.part_of(0.55, F.length(text))) & (hits >= least) & (hits >= F.floor(T.part_of(share, F.size(mine))))



