"""What several operators share: text batches, ASCII folding, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.session import shared_dir, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of text that a task holds in decoded form at once (one longer text is held alone).
CHUNK_CHARS = 2_000_000
#: The same where other stages' models and the JVM want the executor's memory too: lists of words take thirty times the text.
SMALL_CHARS = 250_000
#: What empties each memory that a Python worker keeps for its next tasks.
MEMORIES: list[Callable[[], None]] = []


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


def chunks(batches: Iterator[pa.RecordBatch], *columns: str, size: int = CHUNK_CHARS) -> Iterator[tuple[list, ...]]:
    """Column values of consecutive rows, about `size` bytes of the last column (text) at a time; null text becomes ''.

    Until the last is taken, Python's cycle collector rests: it would walk the operators' large tables over and over. Then
    what is free goes back to the system: Spark keeps the worker for later stages, beside the JVM.
    """
    gc.disable()
    try:
        for batch in batches:
            start, held, lengths = 0, 0, pc.fill_null(pc.binary_length(batch.column(columns[-1])), 0).to_pylist()
            for i, n in enumerate(lengths, 1):
                held += n
                if held >= size or i == len(lengths):
                    values = [batch.column(c).slice(start, i - start).to_pylist() for c in columns]
                    values[-1] = [x or "" for x in values[-1]]
                    yield tuple(values)
                    start, held = i, 0
    finally:
        gc.enable()
        release()


def release() -> None:
    """Give memory that is free back to the system."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def forget() -> None:
    """Empty what tasks of former stages left in this Python worker, which Spark keeps for later stages."""
    for clear in MEMORIES:
        clear()
    release()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (src, dst long): rows (node, component), component the smallest node.

    Alternating large-star and small-star rounds; each is two shuffles over at most the edges there are, and every
    round is a table in the shared folder. Minima are written before they are joined so that both join inputs are
    plain exchanges, which adaptive execution can split at a hub. Null ends and self-links give no row.
    """
    spark = edges.sparkSession
    links = table(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = _star(both, lambda d: d.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = _star(links, lambda d: d.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(d.select("u", F.col("m").alias("v"))))
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = seen


def _star(links: DataFrame, emit) -> DataFrame:
    """Join each (u, v) with m, the smallest of u and its v, then emit and write distinct links (u > v)."""
    least = table(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return table(emit(links.join(least, "u")).where("u <> v").distinct())


__all__ = ["ascii_lower", "chunks", "components", "forget", "shared_dir", "table"]
