"""Lines, sections and records of documents.

``lines`` is the base: everything else windows over (doc_id, ln), so one shuffle
by doc_id serves the whole chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ln (from 1), line of docs(doc_id, text); empty lines are left out but count in ln."""
    at = docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return at.withColumn("ln", (F.col("ln") + 1).cast("long")).where("line <> ''")


def _along() -> W:
    return W.partitionBy("doc_id").orderBy("ln")


def sections(rows: DataFrame, heading: Column) -> DataFrame:
    """Adds ``section``: the last heading line at or above each line, 'start' before the first; and ``block``, its number."""
    upto = _along().rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_h", F.coalesce(heading, F.lit(False))).withColumns({
        "section": F.coalesce(F.last(F.when(F.col("_h"), F.col("line")), ignorenulls=True).over(upto), F.lit("start")),
        "block": F.sum(F.col("_h").cast("long")).over(upto),
    }).drop("_h")


def section_lines(rows: DataFrame, section: Column, all_blocks: bool = True) -> DataFrame:
    """Lines of the sections for which the condition holds; only each document's first such block unless all_blocks."""
    found = rows.where(section)
    if all_blocks:
        return found
    first = W.partitionBy("doc_id")
    return found.withColumn("_b", F.min("block").over(first)).where("block = _b").drop("_b")


def islands(rows: DataFrame, starts: Column, name: str = "rec") -> DataFrame:
    """Adds a record number that grows at every starting line; lines before the first are record 0."""
    upto = _along().rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("long")).over(upto))


def gather(rows: DataFrame, *keys: str, sep: str = " ") -> DataFrame:
    """One row per record: its first line number, its number of lines, and its lines joined in order."""
    got = rows.groupBy("doc_id", *keys).agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("_r"))
    return got.select("doc_id", *keys, F.col("_r")[0]["ln"].alias("ln"), F.size("_r").cast("long").alias("n_lines"), F.array_join("_r.line", sep).alias("text"))


def merge_wrapped(rows: DataFrame, joins: Callable[[Column, Column], Column] = T.is_continuation) -> DataFrame:
    """Appends continuation lines to the line they carry on."""
    before = F.lag("line").over(_along())
    return gather(islands(rows, ~F.coalesce(joins(F.col("line"), before), F.lit(False)), "item"), "item")


def dated_records(rows: DataFrame, date: str = T.YEAR) -> DataFrame:
    """Records that a line with a date starts: title from the start line, or the next line if the date stands alone."""
    is_start = F.col("line").rlike(date)
    there = islands(rows.withColumn("_next", F.lead("line").over(_along())), is_start).where("rec > 0")
    head = F.trim(F.regexp_replace("line", date, ""))
    got = there.groupBy("doc_id", "rec").agg(
        F.min_by("line", "ln").alias("_first"), F.min_by("_next", "ln").alias("_second"), F.min_by(head, "ln").alias("_head"), F.count(F.lit(1)).alias("n_lines"), F.min("ln").alias("ln"))
    return got.select("doc_id", "rec", "ln", F.coalesce(T.blank_to_null(F.col("_head")), "_second").alias("title"), F.regexp_extract("_first", date, 0).alias("year"), "n_lines")


def numbered(rows: DataFrame, n: int) -> DataFrame:
    """The first and last n lines of each document, with their rank from either end."""
    up, down = _along(), W.partitionBy("doc_id").orderBy(F.desc("ln"))
    return rows.withColumns({"from_top": F.row_number().over(up).cast("long"), "from_end": F.row_number().over(down).cast("long")}).where(f"from_top <= {n} or from_end <= {n}")


def within_budget(rows: DataFrame, limit: int, at_least: int = 1) -> DataFrame:
    """Lines while their running length (with a separator each) stays within the limit; always the first ``at_least``."""
    run = F.sum(F.length("line") + 1).over(_along().rowsBetween(W.unboundedPreceding, 0)).cast("long")
    return rows.withColumns(
        {"used": run, "_n": F.row_number().over(_along())}).where(f"used <= {limit} or _n <= {at_least}").drop("_n")


def chunks(rows: DataFrame, limit: int = 6500) -> DataFrame:
    """doc_id, ln, chunk: lines packed into chunks; a line that would pass the limit opens the next. Sorted lengths stream through the
    tasks, and two numbers are carried from line to line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, size = None, 0, 0
        for batch in batches:
            out = []
            for doc, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if doc != at:
                    at, chunk, size = doc, 0, 0
                if size > 0 and size + n > limit:
                    chunk, size = chunk + 1, 0
                size += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["doc_id", "ln", "chunk"])

    lengths = rows.select("doc_id", "ln", F.length("line").cast("long").alias("n"))
    return lengths.repartition("doc_id").sortWithinPartitions("doc_id", "ln").mapInArrow(run, "doc_id long, ln long, chunk long")
