"""Session helpers: a local session for tests and bench, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """Session on one machine; executors' Python finds the package through PYTHONPATH."""
    os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (str(_PACKAGE.parent), os.environ.get("PYTHONPATH", "")) if p)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows and bytes in an Arrow batch: documents are larger than the rows for which the defaults of 10,000 and 64 MB are made.
BATCH_ROWS, BATCH_BYTES = 2_000, "4m"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, and bounds Arrow batches if the session has the default.

    Where PYTHONPATH already leads every Python worker to the package, nothing is sent.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if str(_PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp()) / "paperloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(_PACKAGE.parent).as_posix())
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the session's shared folder, which goes when the JVM ends; where a local session names no folder (tests), one is
    made; on a cluster that is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='paperloom-checkpoint-')}"
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table in the session's shared folder, which cuts its lineage. A table rather than checkpoint(): a checkpoint carries
    its plan's constraints along, and over the rounds of a loop they grow with every expression.
    The shuffles that made it go once it is written."""
    spark = df.sparkSession
    path, before = shared_path(spark, "written"), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
