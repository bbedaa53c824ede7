"""The supplied tables by name, and the rows that derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """``Tables(spark, folder).orders`` reads ``folder/orders.parquet``, once per object."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        got = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, got)
        return got


def admit_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("pdf", "docx", "doc"), max_mb: int = 10) -> DataFrame:
    """path, length, content of the files with an allowed suffix, neither empty nor above the limit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join([*suffixes, *[s.upper() for s in suffixes]]) + "}").option("recursiveFileLookup", "true").load(folder)
    return files.where(f"length > 0 and length <= {max_mb * 1024 * 1024}").select("path", "length", "content")
