"""Secondary indexes as bitmaps: values of array columns (facets) and trigrams of text columns.

An index is rows (key, value, bucket, bits): for each value of a key, and each bucket of 32,768 row numbers, one bit a row.
Filters are bit operations on buckets; rows are read by joining the few buckets that have any. What an index can't tell (a
pattern without three letters in a row) is scanned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.session import carried, table


@dataclass
class BitmapIndex:
    """Bitmaps (key, value, bucket, bits) over the rows whose number (long, not negative) is in `id_col`."""

    bits: DataFrame
    id_col: str


def build(df: DataFrame, id_col: str, values: dict[str, Column], path: str | None = None) -> BitmapIndex:
    """An index of the given arrays of values by key, written once. Null arrays and values are left out, repeated ones count once."""
    if (least := df.agg(F.min(id_col)).first()[0]) is not None and least < 0:
        raise ValueError("row numbers are not negative")
    number = F.col(id_col).cast("long")
    named = lambda k: lambda x: F.struct(F.lit(k).alias("key"), x.alias("value"))
    entries = F.flatten(F.array(*[F.transform(F.coalesce(v, F.array().cast("array<string>")), named(k)) for k, v in values.items()]))
    # Rows of a bucket come together before their values are told apart: a task has a few buckets, whatever the number of rows, and
    # no bitmap is made of a part of a bucket.
    placed = df.where(F.col(id_col).isNotNull()).withColumn("bitmap_bucket", F.bitmap_bucket_number(number))
    buckets = placed.agg(F.countDistinct("bitmap_bucket")).first()[0]
    dealt = placed.repartition(max(1, buckets), "bitmap_bucket")
    # With inline() a filter on the values' number would be inferred, for which all are made before, a second time.
    rows = dealt.select(F.col("bitmap_bucket").alias("bucket"), F.bitmap_bit_position(number).alias("bit"), F.inline_outer(entries)).where("value is not null")
    return BitmapIndex(table(rows.groupBy("key", "value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), path), id_col)


def open_index(spark: SparkSession, path: str, id_col: str) -> BitmapIndex:
    return BitmapIndex(spark.read.parquet(path), id_col)


def all_of(index: BitmapIndex, key: str, values: list[str]) -> DataFrame:
    """Buckets (bucket, bits) of the rows that have all the values."""
    values = sorted(set(values))
    rows = index.bits.where((F.col("key") == key) & F.col("value").isin(*values))
    return rows.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(values)).select("bucket", "bits")


def any_of(index: BitmapIndex, key: str, values: list[str]) -> DataFrame:
    """Buckets of the rows that have one of the values."""
    rows = index.bits.where((F.col("key") == key) & F.col("value").isin(*values))
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def both(parts: list[DataFrame]) -> DataFrame:
    """Buckets of the rows that all selections have."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(parts)).select("bucket", "bits")


def either(parts: list[DataFrame]) -> DataFrame:
    """Buckets of the rows that some selection has."""
    return reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(selection: DataFrame) -> DataFrame:
    """How many rows a selection has: one row (n)."""
    return selection.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def rows_of(df: DataFrame, index: BitmapIndex, selection: DataFrame) -> DataFrame:
    """df's rows that a selection has: others fall at their bucket, or at their bit, before anything else of them is looked at."""
    number = F.col(index.id_col).cast("long")
    bit = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(F.col("selected_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = carried(selection.where(F.bitmap_count("bits") > 0).select(F.col("bucket").alias("selected_bucket"), F.col("bits").alias("selected_bits")))
    met = df.join(near, F.bitmap_bucket_number(number) == F.col("selected_bucket"))
    return met.where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("selected_bucket", "selected_bits")


def facets(index: BitmapIndex, keys: list[str], chosen: dict[str, list[str]], every: tuple[str, ...] = ()) -> DataFrame:
    """Counts (key, value, n) of each facet's values under the filters of the others, those with none left out.

    Of a facet's chosen values a row has one, or all if the facet is among `every`. Only bitmaps are read.
    """
    filters = {k: table(all_of(index, k, v) if k in every else any_of(index, k, v)) for k, v in chosen.items() if v}
    out = []
    for key in keys:
        own, others = index.bits.where(F.col("key") == key), [f for k, f in filters.items() if k != key]
        if others:
            met = own.join(carried(both(others).withColumnRenamed("bits", "mask")), "bucket")
            pairs = met.select("key", "value", "bucket", "bits").unionByName(met.select("key", "value", "bucket", F.col("mask").alias("bits")))
            own = pairs.groupBy("key", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
        out.append(own.groupBy("key", "value").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0"))
    return reduce(DataFrame.unionByName, out)


def trigrams(text: Column) -> Column:
    """A text's stretches of three characters in lower case, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def trigram_index(df: DataFrame, id_col: str, columns: list[str], path: str | None = None) -> BitmapIndex:
    """An index of the trigrams of text columns."""
    return build(df, id_col, {c: trigrams(F.col(c)) for c in columns}, path)


def pieces(pattern: str) -> list[str]:
    """What a LIKE pattern asks for literally: what stands between its wildcards; \\ takes a wildcard as it is."""
    out, now = [], ""
    for part in re.findall(r"\\.|.", pattern, re.S):
        if part in ("%", "_"):
            out, now = [*out, now], ""
        else:
            now += part[-1]
    return [p for p in [*out, now] if p]


def with_pieces(index: BitmapIndex, column: str, literal: list[str]) -> DataFrame | None:
    """A selection of the rows that have all trigrams of these pieces; None where they have none, so that it tells nothing."""
    spark = index.bits.sparkSession
    grams = {g for row in spark.createDataFrame([(p,) for p in literal] or [("",)], "p string").select(trigrams(F.col("p")).alias("g")).collect() for g in row.g}
    return all_of(index, column, sorted(grams)) if grams else None


def _found(df: DataFrame, index: BitmapIndex, selections: list[DataFrame | None], test: Column) -> DataFrame:
    return (df if any(s is None for s in selections) else rows_of(df, index, either(selections))).where(test)


def containing(df: DataFrame, index: BitmapIndex, word: str, columns: list[str]) -> DataFrame:
    """Rows with the word in one of the columns, whatever its case: candidates by trigrams, then contains()."""
    test = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lower(F.lit(word))), F.lit(False)) for c in columns])
    return _found(df, index, [with_pieces(index, c, [word]) for c in columns], test)


def matching(df: DataFrame, index: BitmapIndex, patterns: list[str], column: str) -> DataFrame:
    """Rows whose column is ILIKE one of the patterns: candidates by trigrams of what is literal in them, then ilike()."""
    test = reduce(lambda a, b: a | b, [F.coalesce(F.col(column).ilike(p), F.lit(False)) for p in patterns])
    return _found(df, index, [with_pieces(index, column, pieces(p)) for p in patterns], test)
