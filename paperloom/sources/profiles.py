"""Template profiles: the built-in one, and a parquet-backed table of saved ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Section, rank and label of the built-in template (fixed values).
BUILT_IN = (("summary", 1, "Summary"), ("skills", 2, "Skill Set Overview"), ("education", 3, "Education"), ("certifications", 4, "Certifications"), ("experience", 5, "Experience"))


def built_in(spark: SparkSession) -> DataFrame:
    """section, rank, label of the built-in template."""
    return spark.createDataFrame(list(BUILT_IN), "section string, rank long, label string")


def save(profiles: DataFrame, path: str) -> None:
    """Appends profiles(format_id, name, text, saved_at); a later row with an id replaces the earlier."""
    profiles.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, preview: int = 240) -> DataFrame:
    """The latest row of each id that has not been deleted (null text), newest first, with a short preview."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("format_id").agg(F.max_by(F.struct(*rows.columns), "saved_at").alias("r")).select("r.*")
    return last.where("text is not null").withColumn("preview", F.substring("text", 1, preview)).orderBy(F.desc("saved_at"), "format_id")


def delete(spark: SparkSession, path: str, format_id: str, at: str) -> None:
    """Marks a profile as deleted; raises KeyError for an unknown id."""
    rows = spark.read.parquet(path).where(F.col("format_id") == format_id)
    if rows.isEmpty():
        raise KeyError(format_id)
    gone = rows.limit(1).withColumns({"text": F.lit(None).cast("string"), "saved_at": F.lit(at).cast(rows.schema["saved_at"].dataType)})
    gone.write.mode("append").parquet(path)
