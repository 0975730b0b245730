"""Interval joins against comparing all."""

import random

import pytest

from quarrylane.operators import layout


def rows(rng, n, pages, longest):
    out = []
    for _ in range(n):
        a = rng.uniform(-500, 500)
        out.append((rng.randrange(pages), a, a + rng.choice([rng.uniform(0, 5), rng.uniform(0, longest), 0.0, -1.0, 10.0])))
    return out


def brute(left, right):
    return sorted((p, a, b, c, d) for p, a, b in left for q, c, d in right if p == q and None not in (a, b, c, d) and a < b and c < d and a < d and c < b)


@pytest.mark.parametrize("seed,pages,longest,tile", [(1, 1, 30, 512), (2, 5, 900, 512), (3, 1, 20, 16), (4, 2, 1000, 8)])
def test_overlaps_equal_brute_force(spark, seed, pages, longest, tile, monkeypatch):
    monkeypatch.setattr(layout, "TILE", tile)
    rng = random.Random(seed)
    left, right = rows(rng, 220, pages, longest), rows(rng, 260, pages, longest)
    left += left[:7] + [(0, None, 3.0), (0, 5.0, 5.0)]  # repeated rows, nulls, empty intervals
    l = spark.createDataFrame(left, "page int, l0 double, l1 double").repartition(3)
    r = spark.createDataFrame(right, "page int, r0 double, r1 double").repartition(2)
    found = layout.overlaps(l, r, ["page"]).select("page", "l0", "l1", "r0", "r1").collect()
    assert sorted(map(tuple, found)) == brute(left, right)


def test_a_page_of_very_many_blocks(spark):
    """100,000 short blocks on one page: pairs in proportion to the blocks, and no task that gets the page."""
    left = spark.range(50_000).selectExpr("1 AS page", "id * 10.0D AS l0", "id * 10.0D + 4 AS l1")
    right = spark.range(50_000).selectExpr("1 AS page", "id * 10.0D + 3 AS r0", "id * 10.0D + 6 AS r1")
    found = layout.overlaps(left, right, ["page"])
    assert found.count() == 50_000 and found.where("r0 - l0 <> 3").count() == 0


def test_empty_sides(spark):
    none = spark.createDataFrame([], "page int, l0 double, l1 double")
    some = spark.createDataFrame([(1, 0.0, 1.0)], "page int, r0 double, r1 double")
    assert layout.overlaps(none, some, ["page"]).count() == 0
