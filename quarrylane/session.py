"""Session helpers: building a local session, shipping the package, the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def build(name: str = "quarrylane", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


#: Rows that Python workers get at once, where the session has Spark's default: whole texts are long rows.
BATCH_ROWS = "2000"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, wherever they run, and keep their batches small.

    The package goes out once an application, as an archive of its modules. Of the session's settings one is changed: the
    rows of an Arrow batch, if it has Spark's default.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "quarrylane.zip")  # the driver serves it from here
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:  # sources alone: nothing is compiled beside them
            for source in sorted(Path(ROOT, "quarrylane").rglob("*.py")):
                out.write(source, source.relative_to(ROOT))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder's address below spark.checkpoint.dir, which all executors share, in a folder of this application.

    Only in local mode, and where the session has no such setting, is a temporary folder taken. clear() removes them all.
    """
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quarrylane-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder: call it once results have been taken, for they read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[SparkSession]:
    """Within it results are taken; after it this application's tables in the shared folder are deleted."""
    try:
        yield spark
    finally:
        clear(spark)


def table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The most rows that carried() lets go out by broadcast, and the bytes below which spread() deals rows out anew.
CARRIED, SPREAD = 1 << 18, 256 << 20


def carried(df: DataFrame, most: int = CARRIED) -> DataFrame:
    """df for a join's smaller side: broadcast where a count of its rows says that it is small, else joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is small: a small Parquet file is often one row group, which one task would read and work on.

    By the optimiser's estimate of its bytes, which multiplies the sides of a join, or the bytes of the tables that are read;
    larger inputs, which have more row groups than a cluster has cores, stay as they are.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    size = lambda p: int(p.stats().sizeInBytes())
    leaves = plan.collectLeaves()
    small = min(size(plan), sum(size(leaves.apply(i)) for i in range(leaves.size()))) < SPREAD
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df
