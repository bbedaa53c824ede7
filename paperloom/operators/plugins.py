"""Validators as plug-ins: a table function over each group's rows that says one row per message, callable from SQL.

A validator is a name with a function from a group's texts, in order, to whether they break its rule. A set of them is registered under a
name, and ``SELECT * FROM name(TABLE(rows) PARTITION BY key ORDER BY pos)`` runs it: Spark deals the groups out, rows come as Arrow
batches, and a task holds one group's texts at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf


@dataclass(frozen=True)
class Validator:
    rule_id: str
    section: str
    severity: str  # critical or warn
    issue: str
    broken: Callable[[Sequence[str]], bool]


def register(spark: SparkSession, name: str, validators: Sequence[Validator]) -> None:
    """Makes the set callable from SQL on tables of (key long, text string)."""
    rules = tuple(validators)

    @arrow_udtf(returnType="key long, rule_id string, section string, severity string, issue string")
    class Validate:
        def __init__(self) -> None:
            self.key, self.texts = None, []

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            if rows.num_rows:
                self.key = rows.column(0)[0].as_py()
                self.texts += [t for t in rows.column(1).to_pylist() if t is not None]
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            said = [(self.key, r.rule_id, r.section, r.severity, r.issue) for r in rules if self.texts and r.broken(self.texts)]
            self.texts = []
            if said:
                key, *words = zip(*said, strict=True)
                yield pa.table([pa.array(key, pa.int64()), *[pa.array(w, pa.string()) for w in words]], names=["key", "rule_id", "section", "severity", "issue"])

    spark.udtf.register(name, Validate)


def validate(rows: DataFrame, name: str, key: str, order: str, text: str) -> DataFrame:
    """key, rule_id, section, severity, issue of a registered set over rows grouped by key, in order."""
    spark = rows.sparkSession
    view = f"_{name}_rows"
    rows.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text", f"`{order}` as pos").createOrReplaceTempView(view)
    got = spark.sql(f"SELECT * FROM {name}(TABLE(SELECT key, text, pos FROM {view}) PARTITION BY key ORDER BY pos)")
    return got.withColumnRenamed("key", key)
