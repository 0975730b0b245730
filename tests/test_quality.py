"""Order statistics by refined histograms and by sketches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarrylane.plans import quality
from quarrylane.session import shared_dir
from quarrylane.session import table as written


@pytest.fixture(scope="module")
def values():
    rng = random.Random(12)
    return {
        "wide": [rng.lognormvariate(0, 8) for _ in range(6000)], "ties": [float(rng.randrange(4)) for _ in range(500)], "one": [3.5],
        "clustered": [1e9 + rng.random() * 1e-3 for _ in range(3000)] + [-1e9, 1e300], "two": [1.0, 2.0], "ends": [math.inf] * 30 + [-math.inf] * 40 + [0.0] * 30, "same": [7.0] * 900,
    }


def frame(spark, values):
    rows = [(g, v) for g, own in values.items() for v in own] + [("wide", None), ("wide", math.nan), ("none", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(4)


@pytest.mark.parametrize("cuts,few", [(4, 3), (1024, 4096), (16, 200)])
def test_exact_ranks(spark, values, cuts, few, monkeypatch):
    monkeypatch.setattr(quality, "CUTS", cuts)
    monkeypatch.setattr(quality, "FEW", few)
    if cuts == 4:  # many rounds: smaller groups
        values = {k: v[:300] for k, v in values.items()}
    n = F.col("n")
    found = quality.ranked_values(frame(spark, values), "v", ["g"], {"least": F.lit(0), "p30": F.floor(n * 0.3), "p95": F.floor(n * 0.95), "most": n - 1})
    got = {(r.g, r.name): r.value for r in found.collect()}
    rank = {"least": lambda n: 0, "p30": lambda n: math.floor(n * 0.3), "p95": lambda n: math.floor(n * 0.95), "most": lambda n: n - 1}
    assert got == {(g, name): sorted(own)[f(len(own))] for g, own in values.items() for name, f in rank.items()}


def test_percentiles_as_spark_has_them(spark, values):
    df = frame(spark, {k: v for k, v in values.items() if k != "ends"}).where("not isnan(v)")
    for share in (0.0, 0.5, 0.95, 1.0):
        want = {r.g: r.p for r in df.groupBy("g").agg(F.expr(f"percentile(v, {share})").alias("p")).where("p is not null").collect()}
        assert {r.g: r.value for r in quality.percentile(df, "v", ["g"], share).collect()} == pytest.approx(want)


def test_no_window_over_a_group_alone(spark, values):
    text = quality.latency(frame(spark, {"two": [1.0, 2.0]}), "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text


def test_sketches_of_days_are_merged(spark):
    rng = random.Random(2)
    rows = [(d, rng.choice("ab"), rng.expovariate(1.0)) for d in range(10) for _ in range(3000)]
    df = spark.createDataFrame(rows, "day int, g string, v double")
    path = shared_dir(spark)
    written(quality.sketches(df, "v", ["g", "day"]), path)
    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    got = quality.quantiles_of(spark.read.parquet(path), ["g"], shares).collect()
    assert len(got) == 2
    for r in got:
        own = sorted(v for _, g, v in rows if g == r.g)
        for name, share in shares.items():
            assert abs(sum(v <= r[name] for v in own) / len(own) - share) <= 0.01
