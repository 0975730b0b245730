"""Page layout: text blocks in reading order, overlap of columns, choice of a parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.session import carried, table


#: Blocks that are compared in one place; a bin with more on both sides is split into tiles of about half as many.
TILE = 512


def overlaps(left: DataFrame, right: DataFrame, by: list[str], width: float | None = None) -> DataFrame:
    """Pairs of intervals that overlap, with all columns of both sides: left has (by, l0, l1), right has (by, r0, r1).

    Intervals are half open; empty and null ones meet nothing. Each goes to the bins that it reaches, and a pair meets in
    the first bin that both have, once. Bins are `width` wide, by default twice the mean length of all intervals. A bin
    with very many intervals is met in tiles, so that none of a task's joins grows with a page's blocks squared unless
    the pairs themselves do; long intervals go to bins of their own size.
    """
    sound = lambda df, a, b: df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) < F.col(b)))
    left, right = sound(left, "l0", "l1"), sound(right, "r0", "r1")
    if width is None:
        size = left.select((F.col("l1") - F.col("l0")).alias("s")).unionByName(right.select((F.col("r1") - F.col("r0")).alias("s"))).agg(F.avg("s")).first()[0]
        width = max(2.0 * (size or 1.0), 1e-9)
    # A level's bins are twice as wide as those of the level below: an interval is in at most two or three bins of its own level.
    level = lambda a, b: F.greatest(F.ceil(F.log2((F.col(b) - F.col(a)) / width)), F.lit(0)).cast("int")
    left, right = left.withColumn("l_level", level("l0", "l1")), right.withColumn("r_level", level("r0", "r1"))
    levels = [r[0] for r in left.select(F.col("l_level").alias("x")).unionByName(right.select(F.col("r_level").alias("x"))).distinct().collect()]  # at most as many as a double has exponents

    def binned(df: DataFrame, a: str, b: str, own: str) -> DataFrame:
        """An interval is in its own level's bins, and in those of every higher level that some interval has."""
        higher = F.filter(F.array(*[F.lit(x) for x in sorted(levels)] or [F.lit(0)]), lambda x: x >= F.col(own))
        step = lambda x: F.pow(F.lit(2.0), x) * width
        return df.select("*", F.explode(higher).alias("level")).select("*", F.explode(F.sequence(F.floor(F.col(a) / step(F.col("level"))), F.ceil(F.col(b) / step(F.col("level"))) - 1)).alias("bin"))

    keys = [*by, "level", "bin"]
    l, r = binned(left, "l0", "l1", "l_level"), binned(right, "r0", "r1", "r_level")
    counts = l.groupBy(*keys).agg(F.count("*").alias("l_n")).join(r.groupBy(*keys).agg(F.count("*").alias("r_n")), keys)
    hot = table(counts.where((F.col("l_n") > TILE) & (F.col("r_n") > TILE)).select(*keys, F.ceil(F.col("l_n") / (TILE // 2)).alias("l_tiles"), F.ceil(F.col("r_n") / (TILE // 2)).alias("r_tiles")))

    def tiled(df: DataFrame, own: str, other: str) -> DataFrame:
        """In hot bins a row has a tile of its own side, and goes to each of the other's."""
        met = df.join(carried(hot), keys, "left")
        mine = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).alias(f"{own}_at")  # by the row's values: the same if a task is run again
        return met.select("*", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)).cast("long") - 1)).alias(f"{other}_at")).drop("l_tiles", "r_tiles")

    l, r = tiled(l, "l_tiles", "r_tiles"), tiled(r, "r_tiles", "l_tiles")
    pairs = l.join(r, [*keys, "l_tiles_at", "r_tiles_at"]).where((F.col("l0") < F.col("r1")) & (F.col("r0") < F.col("l1")))
    # Once: at the level of the longer one, in the first bin that both reach.
    first = F.floor(F.greatest("l0", "r0") / (F.pow(F.lit(2.0), F.col("level")) * width))
    once = pairs.where((F.col("level") == F.greatest("l_level", "r_level")) & (F.col("bin") == first))
    return once.drop("level", "bin", "l_level", "r_level", "l_tiles_at", "r_tiles_at")


def overlapping_blocks(blocks: DataFrame, width: Column) -> DataFrame:
    """Pairs of a left and a right block (page, x0, y0, x1, y1) that share some height: an interval join by page."""
    middle = width / 2
    left = blocks.where(F.col("x1") <= middle * 1.05).select("page", F.col("y0").alias("l0"), F.col("y1").alias("l1"))
    right = blocks.where((F.col("x1") > middle * 1.05) & (F.col("x0") >= middle * 0.95)).select("page", F.col("y0").alias("r0"), F.col("y1").alias("r1"))
    return overlaps(left, right, ["page"])


def complex_pages(blocks: DataFrame, width: Column) -> DataFrame:
    """Pages (page, is_complex): two blocks or more in each column, and two overlaps or more."""
    middle = width / 2
    left = F.col("x1") <= middle * 1.05
    sides = blocks.groupBy("page").agg(F.count_if(left).alias("lefts"), F.count_if(~left & (F.col("x0") >= middle * 0.95)).alias("rights"))
    overlaps = overlapping_blocks(blocks, width).groupBy("page").agg(F.count("*").alias("overlaps"))
    return sides.join(overlaps, "page", "left").select("page", ((F.col("lefts") >= 2) & (F.col("rights") >= 2) & (F.coalesce("overlaps", F.lit(0)) >= 2)).alias("is_complex"))


def reading_order(blocks: Column) -> Column:
    """Text of blocks (array of struct<y0, x0, text, type>) from top to bottom, left to right; empty ones and images out."""
    own = F.filter(blocks, lambda b: (b["type"] == 0) & (F.trim(b["text"]) != ""))
    ordered = F.array_sort(F.transform(own, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), F.trim(b["text"]).alias("text"))))
    return F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n")


def parser(is_complex: Column, text: Column, deep_fails: Column) -> Column:
    """The engine that reads a file: deep for complex layouts (else the simple one stands in), and for sparse simple text."""
    sparse = F.length(F.trim(text)) < 50
    return (
        F.when(is_complex & deep_fails, "simple_fallback").when(is_complex, "deep")
        .when(sparse & ~deep_fails, "deep").otherwise("simple")
    )


def accepted(mime: Column, name: Column) -> Column:
    """Is an upload taken: by its type or its name."""
    return mime.isin("application/pdf", "application/x-pdf", "application/octet-stream") | F.lower(name).endswith(".pdf")
