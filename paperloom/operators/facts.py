"""Facts of nested records of any depth: every leaf with its id, its record, its position and its text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def nested_facts(rows: DataFrame, key: str, store: str) -> DataFrame:
    """key, fact_id, parent, pos, text of the leaves of a VARIANT column.

    A fact's id is its path: names joined by dots, places in lists behind the name (``exp0.b2``). parent is the id of the list item that holds
    it as a field or in a field's list ('' outside any), pos its place if it stands in a list itself. Blank and null leaves are left out. One
    lateral explode a level, each a written table, until a level holds no more lists or objects; the depth need not be known.
    """
    level = rows.select(F.col(key).alias("k"), F.lit("").alias("path"), F.lit("").alias("owner"), F.col(store).alias("v"))
    kind, leaves = F.schema_of_variant("value"), []
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    while True:
        # objects give names, lists give places
        opened = level.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
        path = F.when(F.col("key").isNull(), F.concat("path", F.col("pos").cast("string"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        place = F.when(F.col("key").isNull(), F.col("pos").cast("long"))
        item = F.when(F.col("key").isNull() & kind.startswith("OBJECT"), path).otherwise(F.col("owner"))
        step = written(opened.select("k", path.alias("path"), item.alias("owner"), place.alias("place"), "value", nested.alias("nested")))
        leaves.append(step.where("not nested").select(F.col("k").alias(key), F.col("path").alias("fact_id"), F.col("owner").alias("parent"), F.col("place").alias("pos"), F.col("value").cast("string").alias("text")))
        level = step.where("nested").select("k", "path", "owner", F.col("value").alias("v"))
        if level.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, leaves).where(F.trim("text") != "")
