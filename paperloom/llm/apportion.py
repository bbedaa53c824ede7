"""Mixing sources to target weights by Sainte-Laguë apportionment (native DataFrame operations only).

1. Each source's target is its weight's share of the budget, at most ``epochs``
   times what it holds; what is above goes to the others by weight. The fixed
   point of that is a water level: sources sorted by cap/weight are capped as a
   prefix, and the level follows from prefix sums.
2. Seats are blocks of ``block_tokens``. A source gets them by highest quotients
   target/(2k+1). Only quotients near the quota can be decided by the ranking
   (all before them are won, none after), so a source lists a few of them and
   not one per block. A source's seats are dealt to its shards the same way, by
   shard size; shards hold about ``shard_docs`` documents each, so a source with
   a third of all rows is many shards.
3. Inside a shard, documents stand in a seeded order, end to end; the quota takes the first blocks
   along that order, in whole passes first and then a part of one. So the seed selects the blocks, and a document's
   blocks stay together.

Edge cases: null or blank texts have size 0 and take 0; a null source is a
source of its own (last); repeated rows each count; null doc_ids are kept; an
empty table gives an empty result; other columns are left alone and dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, Scratch, small


def seats(
    votes: DataFrame, group: Sequence[str], item: Sequence[str], vote: str, total: str
) -> DataFrame:
    """Sainte-Laguë seats of each item within its group.

    votes: one row per item with a numeric ``vote`` and the group's ``total``
    seats. Adds ``seats`` (long). Exact: the divisor that gives ``total`` seats
    differs from votes/total by less than the rounding of all items, which bounds
    how far an item's seats are from its quota; only that stretch is ranked.
    """
    every = W.partitionBy(*[F.col(c) for c in group])
    quota = F.when(F.col("_votes") > 0, F.col(vote) * F.col(total) / F.col("_votes")).otherwise(0.0)
    near = (
        votes.withColumn("_votes", F.sum(vote).over(every))
        .withColumn("_items", F.count(F.lit(1)).over(every))
        .withColumn("_quota", quota)
        .withColumn("_reach", F.ceil(F.col("_quota") * F.col("_items") / F.greatest(F.lit(1), F.col(total)) / 2).cast("long") + 2)
        .withColumn("_low", F.greatest(F.lit(0).cast("long"), F.floor("_quota").cast("long") - F.col("_reach")))
        .withColumn("_open", F.col(total) - F.sum("_low").over(every))
        .withColumn("_seat", F.explode(F.sequence("_low", F.col("_low") + 2 * F.col("_reach") + 1)))
        .withColumn("_quotient", F.col(vote) / (2 * F.col("_seat") + 1))
    )
    order = every.orderBy(F.col("_quotient").desc(), *[F.col(c).asc_nulls_last() for c in item], "_seat")
    keys = [*group, *item]
    return (
        near.withColumn("_won", ((F.row_number().over(order) <= F.col("_open")) & (F.col(vote) > 0)).cast("long"))
        .groupBy(*keys)
        .agg((F.first("_low") + F.sum("_won")).alias("seats"))
    )


def targets(sources: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """source, source_size → target: weighted shares of ``share`` × all sizes, capped at ``epochs`` × source_size.

    One row per source goes through a single-task window: sources are named
    collections, not rows.
    """
    n = len(weights)
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_rank") - 1) % n + 1).cast("int"))
    ratio = F.col("source_size") / F.col("_weight")
    before = W.orderBy("_ratio", "_rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (
        sources.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_weight", pick)
        .withColumn("_ratio", epochs * ratio)
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("_weight").over(every))
        .withColumn("_full", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_heavy", F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        # the level if exactly the sources before this one were capped
        .withColumn("_level", (share * F.col("_all") - epochs * F.col("_full")) / (F.col("_weights") - F.col("_heavy")))
        .withColumn("_stop", F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_rank", "_level")))
    )
    level = F.min("_stop").over(every)["_level"]
    cap = (epochs * F.col("source_size")).cast("double")
    return ranked.select(
        "source", "source_size", F.coalesce(F.least(cap, F.col("_weight") * level), cap).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    block_tokens: int = 32,
    shard_docs: int = 2_000,
    seed: str = "mix",
    scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs(doc_id, text, source)."""
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))), F.lit(0))
    sized = scratch.store(docs.select("doc_id", "source", F.when(F.col("text").isNull(), 0).otherwise(size).cast("long").alias("size")), "sized")
    sources = targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")).select("source", "source_size"),
        weights, share, epochs,
    )
    counts = sized.groupBy("source").agg(F.count(F.lit(1)).alias("_docs"))
    sources = (
        sources.join(counts, sources.source.eqNullSafe(counts.source)).drop(counts.source)
        .withColumn("_shards", F.ceil(F.col("_docs") / shard_docs).cast("long"))
        .withColumn("_g", F.lit(1))
        .withColumn("_total", F.round(F.sum("target").over(W.partitionBy("_g")) / block_tokens).cast("long"))
    )
    sources = scratch.store(sources, "sources")
    won = seats(sources, ["_g"], ["source"], "target", "_total").drop("_g")
    sources = scratch.store(
        sources.join(won, sources.source.eqNullSafe(won.source)).drop(won.source)
        .select("source", "source_size", "target", "_shards", F.col("seats").alias("_quota_blocks")), "seats")

    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    there = small(sources.withColumnRenamed("source", "_source"))
    placed = (
        sized.join(there, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("_place", place)
        .withColumn("_shard", F.conv(F.substring("_place", 1, 8), 16, 10).cast("long") % F.col("_shards"))
    )
    shards = placed.groupBy("source", "_shard").agg(F.sum("size").alias("_shard_size"), F.first("_quota_blocks").alias("_quota_blocks"))
    shards = scratch.store(shards, "shards")
    dealt = seats(shards, ["source"], ["_shard"], "_shard_size", "_quota_blocks").withColumnRenamed("source", "_source").withColumnRenamed("_shard", "_no")
    shards = scratch.store(
        shards.join(dealt, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_no")))
        # rounding to blocks may pass what the shard can give
        .select(F.col("source").alias("_source"), F.col("_shard").alias("_no"), "_shard_size", F.least(F.col("seats") * block_tokens, epochs * F.col("_shard_size")).alias("_quota")), "quotas")
    along = W.partitionBy("source", "_shard").orderBy("_place", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_quota") - F.col("_passes") * F.col("_shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_before")))
    return (
        placed.join(small(shards), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_no")))
        .withColumn("_before", F.coalesce(F.sum("size").over(along), F.lit(0)))
        .withColumn("_passes", F.when(F.col("_shard_size") > 0, F.floor(F.col("_quota") / F.col("_shard_size"))).otherwise(0))
        .select("doc_id", "size", "source_size", "target", (F.col("_passes") * F.col("size") + part).cast("long").alias("taken"))
    )
