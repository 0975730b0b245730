"""Retrieval quality: recall at k, reciprocal rank, means, latency statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.session import carried, table


def retrieval_metrics(results: DataFrame, relevant: DataFrame, queries: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """For each query recall at each cut-off (hits over the smaller of k and the relevant) and reciprocal rank up to 20.

    results (query_id, doc_id, rank), relevant (query_id, doc_id), queries (query_id). A query without anything relevant
    has one everywhere.
    """
    wanted = relevant.select("query_id", "doc_id").distinct()
    size = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = results.join(wanted, ["query_id", "doc_id"], "left_semi")
    per = hits.groupBy("query_id").agg(
        *[F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"hits_{k}") for k in cutoffs], F.min(F.when(F.col("rank") <= 20, F.col("rank"))).alias("first")
    )
    rows = queries.select("query_id").join(size, "query_id", "left").join(per, "query_id", "left")
    return rows.select(
        "query_id",
        *[F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce(F.col(f"hits_{k}") / F.least(F.lit(k), F.col("n")), F.lit(0.0))).alias(f"recall_{k}") for k in cutoffs],
        F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr_20"),
    )


#: Buckets that a range of values is cut into, and the distinct values below which a range isn't cut again.
CUTS, FEW = 1024, 4096


def ranked_values(df: DataFrame, column: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics by group: a row (by, name, value) for each of `ranks`, numbers from 0 made of the group's count `n`.

    By refining histograms: values are counted in CUTS buckets of their group's range, then only the bucket that has the rank
    is looked at again, until it has few distinct values. A round shuffles counts, at most CUTS of a group and name, never a
    group's values; the last one gathers at most FEW distinct values of each. Null and NaN values are left out, and groups
    that have no others; infinite ones are the ends of the order.
    """
    spark, keys = df.sparkSession, [*by, "name"]
    value = F.col(column).cast("double")
    rows = table(df.where(value.isNotNull() & ~F.isnan(value)).groupBy(*by, value.alias("value")).agg(F.count("*").alias("c")))
    finite = F.abs("value") != float("inf")
    sizes = rows.groupBy(*by).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("value") == float("-inf"), F.col("c")).otherwise(0)).alias("under"), F.sum(F.when(finite, F.col("c")).otherwise(0)).alias("f"),
        F.min(F.when(finite, F.col("value"))).alias("low"), F.max(F.when(finite, F.col("value"))).alias("high"),
    )
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(r.cast("long"), F.lit(0)).alias("rank")) for k, r in ranks.items()]))
    open_ = table(sizes.select("*", names.alias("x")).select(*by, "x.name", F.least("x.rank", F.col("n") - 1).alias("rank"), "under", "f", "low", "high"))
    edge = F.when(F.col("rank") < F.col("under"), F.lit(float("-inf"))).when(F.col("rank") >= F.col("under") + F.col("f"), F.lit(float("inf")))
    done = [open_.withColumn("value", edge).where("value is not null").select(*keys, "value")]
    open_ = table(open_.where(edge.isNull()).select(*keys, (F.col("rank") - F.col("under")).alias("rank"), "low", "high"))
    while True:
        near = rows.join(carried(open_), by).where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
        sized = table(near.groupBy(*keys).agg(F.count("*").alias("distinct"), F.first("rank").alias("rank"), F.first("low").alias("low"), F.first("high").alias("high")))
        few = sized.where((F.col("distinct") <= FEW) | (F.col("low") == F.col("high")))
        last = near.join(carried(few.select(*keys)), keys, "left_semi").groupBy(*keys).agg(F.first("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("value", "c"))).alias("v"))
        start = F.struct(F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("upto"))
        walk = lambda a, x: F.struct(F.when(a["value"].isNull() & (a["upto"] + x["c"] > F.col("rank")), x["value"]).otherwise(a["value"]).alias("value"), (a["upto"] + x["c"]).alias("upto"))
        done.append(table(last.select(*keys, F.aggregate("v", start, walk)["value"].alias("value"))))
        more = sized.where((F.col("distinct") > FEW) & (F.col("low") < F.col("high"))).select(*keys, "rank", "low", "high")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, done)
        part = F.least(F.floor((F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * CUTS), F.lit(CUTS - 1))
        cut = rows.join(carried(more), by).where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).groupBy(*keys, part.alias("part")).agg(
            F.sum("c").alias("c"), F.first("rank").alias("rank"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("part"))  # at most CUTS rows of each
        within = cut.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        open_ = table(within.select(*keys, (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), "low", "high"))


def latency(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean, median, nearest-rank 95th percentile (by truncation), least and largest, by group."""
    n = F.col("n")
    found = ranked_values(df, column, by, {"below": F.floor((n - 1) / 2), "above": F.ceil((n - 1) / 2), "p95": F.least(F.floor(n * 0.95), n - 1)})
    kind = df.schema[column].dataType.simpleString()
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ("below", "above", "p95")])
    wide = wide.select(*by, ((F.col("below") + F.col("above")) / 2).alias("median"), F.col("p95").cast(kind).alias("p95"))
    rest = df.groupBy(*by).agg(F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("largest"))
    return rest.join(wide, by).select(*by, "mean", "median", "least", "largest", "p95")


def percentile(df: DataFrame, column: str, by: list[str], share: float) -> DataFrame:
    """Rows (by, value): the percentile by linear interpolation between the two nearest ranks."""
    place = (F.col("n") - 1) * share
    found = ranked_values(df, column, by, {"below": F.floor(place), "above": F.ceil(place)})
    ends = found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ("below", "above")])
    sizes = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(*by).agg(F.count("*").alias("n"))
    between = F.col("below") + (place - F.floor(place)) * (F.col("above") - F.col("below"))
    return ends.join(sizes, by).select(*by, F.when(F.col("below") == F.col("above"), F.col("below")).otherwise(between).alias("value"))


def sketches(df: DataFrame, column: str, by: list[str], size: int = 400) -> DataFrame:
    """Mergeable sketches (by, sketch) of a column's values (KLL, as doubles), to be stored, by day say; see quantiles_of()."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), size).alias("sketch"))


def quantiles_of(stored: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Quantiles of stored sketches, merged to the groups `by`: ranks are right to about 1 % of the values (size 400, measured in the tests)."""
    merged = stored.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*by, *[F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(name) for name, s in shares.items()])
