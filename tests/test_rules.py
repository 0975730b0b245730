"""The relevance rule is judged on sets of skills, and rows meet by equality alone."""

import glob
import os

from pyspark.sql import functions as F

from quarrylane.plans import retrieval


def test_relevance_rule_is_not_judged_for_each_pair(spark):
    import __spark_entry__ as entry

    found = entry.queries()["j13_relevance_rule"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "HashJoin" in line or "MergeJoin" in line]
    assert joins and not any("arrays_overlap" in line for line in plan.splitlines())
    assert found.count() == found.distinct().count() > 0


def test_pairs_take_less_than_a_byte_each(spark, tmp_path):
    """The pairs grow with the square of the tables: in the order of a join they took five bytes each."""
    import __spark_entry__ as entry

    for name in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, key, n, step in (("customer", "c_custkey", 600, 5), ("part", "p_partkey", 12000, 50)):
        one = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(1).drop(key)
        spark.range(n).select((F.col("id") * step).alias(key)).crossJoin(one).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    entry.queries()["j13_relevance_rule"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    c = spark.read.parquet(f"{tmp_path}/customer.parquet").select(F.col("c_custkey").alias("d"))
    j = spark.read.parquet(f"{tmp_path}/part.parquet").select(F.col("p_partkey").alias("q"))
    want = c.crossJoin(j).where("d % 2 = 0 or d % 3 = q % 3 or d % 4 = q % 4")
    total = lambda df, *ids: tuple(df.select(F.count("*"), F.sum(F.xxhash64(*ids).cast("decimal(38,0)"))).first())
    assert total(out, "query_id", "doc_id") == total(want, "q", "d")
    assert sum(map(os.path.getsize, glob.glob(f"{tmp_path}/out/*.parquet"))) < out.count()


def test_tiled_pairs_keep_every_row(spark, monkeypatch):
    """Repeated rows, ids below zero and far apart, keys that are null or meet nothing; tiles of all sizes, broadcast or not."""
    docs = [(d, d % 3 if d % 7 else None) for d in (*range(-40, 60), 5, 5, 1 << 60)]
    queries = [(q, q % 4) for q in (*range(30), 5, 1 << 61)]
    want = sorted((q, d) for d, k in docs for q, x in queries if k == x)
    sides = [spark.createDataFrame(rows, f"{name} long, key long") for rows, name in ((docs, "doc_id"), (queries, "query_id"))]
    for doc_stretch, query_stretch, cycle, at_once, broadcast in ((1 << 11, 1 << 20, 504, 1 << 16, 512), (8, 4, 3, 5, 1)):
        for name, value in zip(("DOC_STRETCH", "QUERY_STRETCH", "CYCLE", "PAIRS", "CARRIED_TILES"), (doc_stretch, query_stretch, cycle, at_once, broadcast), strict=True):
            monkeypatch.setattr(retrieval, name, value)
        assert sorted(map(tuple, retrieval.tiled_pairs(*sides, ["key"]).collect())) == want
