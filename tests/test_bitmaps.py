"""Bitmap and trigram indexes against scans."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylane.plans import bitmaps as B
from quarrylane.session import shared_dir


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    names = ["".join(rng.choices("abAB %_\\é", k=rng.randrange(0, 14))) for _ in range(1200)]
    data = [(i * 77, n if i % 50 else None, "".join(rng.choices("xyz", k=5)), rng.sample(["Go", "Python", "C++", "Git"], rng.randrange(0, 4)) if i % 40 else None, rng.choice("pqr")) for i, n in enumerate(names)]
    return spark.createDataFrame(data, "id long, name string, other string, skills array<string>, stage string").cache()


@pytest.fixture(scope="module")
def grams(rows):
    return B.trigram_index(rows, "id", ["name", "other"])


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_substrings_as_by_scanning(spark, rows, grams):
    rng = random.Random(4)
    for size in (1, 2, 3, 4, 5, 7):
        for _ in range(3):
            word = "".join(rng.choices("abAB é", k=size))
            want = rows.where(F.lower("name").contains(word.lower()) | F.lower("other").contains(word.lower()))
            assert ids(B.containing(rows, grams, word, ["name", "other"])) == ids(want)
    assert ids(B.containing(rows, grams, "xyzzy", ["other"])) == ids(rows.where("other = 'xyzzy'"))


@pytest.mark.parametrize("pattern", ["%abA%", "a%bab%a", "%ab_ba%", "%\\%ab%", "aba%", "%é_a%", "%", "", "___", "%a\\_b%", "%ABAB"])
def test_patterns_as_by_scanning(rows, grams, pattern):
    assert ids(B.matching(rows, grams, [pattern, "%bbb%"], "name")) == ids(rows.where(F.col("name").ilike(pattern) | F.col("name").ilike("%bbb%")))


def test_pieces_of_patterns():
    assert B.pieces("%ab_c\\%d%%e") == ["ab", "c%d", "e"] and B.pieces("%_") == [] and B.pieces("x\\\\y") == ["x\\y"]


def test_only_candidates_are_read(rows, grams):
    candidates = B.rows_of(rows, grams, B.with_pieces(grams, "other", ["xyzx"])).count()
    matches = rows.where("other like '%xyzx%'").count()
    assert matches <= candidates <= 2 * matches + 5 < rows.count() / 4
    assert B.with_pieces(grams, "other", ["xy"]) is None


def test_facets_and_filters_as_by_scanning(spark, rows):
    path = shared_dir(spark)
    B.build(rows, "id", {"skills": F.col("skills"), "stage": F.array("stage")}, path)
    index = B.open_index(spark, path, "id")
    for wanted in (["Go"], ["Go", "Python"], ["Go", "Git", "C++"], ["none"]):
        has_all = F.forall(F.array(*map(F.lit, wanted)), lambda w: F.array_contains("skills", w))
        assert ids(B.rows_of(rows, index, B.all_of(index, "skills", wanted))) == ids(rows.where(has_all))
        assert B.counted(B.all_of(index, "skills", wanted)).first().n == rows.where(has_all).count()
        has_any = F.arrays_overlap("skills", F.array(*map(F.lit, wanted)))
        chosen = B.both([B.any_of(index, "skills", wanted), B.any_of(index, "stage", ["p", "q"])])
        assert ids(B.rows_of(rows, index, chosen)) == ids(rows.where(has_any & F.col("stage").isin("p", "q")))
        for every, test in (((), has_any), (("skills",), has_all)):
            got = {(r.key, r.value): r.n for r in B.facets(index, ["skills", "stage"], {"skills": wanted, "stage": ["p", "r"]}, every).collect()}
            skills = rows.where(F.col("stage").isin("p", "r")).select(F.explode("skills").alias("v")).groupBy("v").count().collect()
            stages = rows.where(test).groupBy("stage").count().collect()
            assert got == {("skills", r.v): r["count"] for r in skills} | {("stage", r.stage): r["count"] for r in stages}
    plan = B.facets(index, ["skills"], {"stage": ["p"]})._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_odd_tables(spark):
    none = spark.createDataFrame([], "id long, name string")
    index = B.trigram_index(none, "id", ["name"])
    assert B.containing(none, index, "abcd", ["name"]).count() == 0
    odd = spark.createDataFrame([(None, "abcd"), (5, "abcd"), (5, "xabcd"), (1 << 40, "abcde")], "id long, name string")
    assert [r.id for r in B.containing(odd, B.trigram_index(odd, "id", ["name"]), "abcd", ["name"]).orderBy("id").collect()] == [5, 5, 1 << 40]
    with pytest.raises(ValueError, match="negative"):
        B.trigram_index(spark.createDataFrame([(-1, "a")], "id long, name string"), "id", ["name"])


def test_trigrams_of_a_bucket_are_gathered_before_they_are_told_apart(spark):
    """One shuffle, of rows and by buckets, with a partition for each bucket; a column called bucket is none of the index's business."""
    rows = spark.range(5 * 32768).select("id", F.lit("7").alias("bucket"), F.concat(F.lit("abc"), (F.col("id") % 3).cast("string")).alias("t"))
    index = B.trigram_index(rows, "id", ["t", "bucket"])
    assert {r.n for r in index.bits.where("value = 'abc'").select(F.bitmap_count("bits").alias("n")).collect()} <= {32767, 32768, 1}
    assert index.bits.where("value = 'abc'").select(F.sum(F.bitmap_count("bits"))).first()[0] == 5 * 32768
    assert B.containing(rows, index, "BC1", ["t"]).count() == rows.where("id % 3 = 1").count()
