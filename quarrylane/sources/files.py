"""Files in and out: page blocks, quarantine, appended ledgers, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files as rows (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 32, **options: str) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric key; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """rows with nulls, and columns that aren't there, filled."""
    have = {c: F.coalesce(c, F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()}
    return rows.withColumns(have)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_csv(rows: DataFrame, path: str, names: dict[str, str]) -> None:
    """A small report as one CSV file with a header."""
    rows.select(*[F.col(c).alias(n) for c, n in names.items()]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON document."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("body"))
