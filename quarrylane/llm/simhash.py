"""Operator 9, SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint is cut into three segments. If two fingerprints differ in at most four bits, some segment of theirs
differs in at most one, so that they share the variant of that segment with one bit struck out. Each distinct
fingerprint is indexed under its 64 variants (one for each bit of each segment); fingerprints that meet under one are
verified, and what a meeting links is passed on as a spanning set of links, never as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.common import chunks, components, table
from quarrylane.session import carried

#: Bits of each segment; together 64, and floor(4 / 3) = 1 bit may differ in the best of them.
SEGMENTS = (22, 21, 21)
#: Above this many fingerprints under one variant, links are found by search from each unvisited one.
SMALL = 24
#: The most fingerprints that meet in one task; where more have a variant in common, blocks of half as many meet two by two.
HOT = 1 << 17


def fingerprint(text: bytes, width: int) -> int:
    """The fingerprint of UTF-8 bytes: majority bits of XXH64 (seed 42) over shingles of `width` words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    h = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64, len(starts))
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of some 64-bit hashes have."""
    over = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # bounded memory for texts of any length
        over += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(over * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp long: the fingerprint's 64 bits) for each document; a text without words has zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, "id", "text"):
            fps = np.array([fingerprint(t.encode(), width) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), "fp": pa.array(fps, pa.int64())})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def variant(fp: Column, bit: Column) -> Column:
    """A fingerprint's key for one of its 64 bits: that bit's segment with the bit struck out, tagged by the bit's place."""
    key, low = None, 0
    for size in SEGMENTS:
        segment = F.call_function("shiftrightunsigned", fp, F.lit(low)).bitwiseAND(F.lit((1 << size) - 1))
        struck = segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), (bit - low).cast("int"))))
        key = struck if key is None else F.when(bit < low, key).otherwise(struck)
        low += size
    return key.bitwiseOR(F.call_function("shiftleft", bit.cast("long"), F.lit(32)))


def hot_variants(prints: DataFrame) -> DataFrame:
    """Keys (key, n) that more than HOT of the distinct fingerprints (fp long) have, as a written table.

    Two values of a segment have a key, those with and without the struck bit, so that one of them has more than half as many
    fingerprints. Three values of each fingerprint are counted instead of its 64 keys; there are at most 2^23 values in all.
    """
    lows = np.cumsum((0, *SEGMENTS))[:-1].tolist()
    cut = [F.struct(F.lit(k).alias("low"), F.call_function("shiftrightunsigned", "fp", F.lit(k)).bitwiseAND(F.lit((1 << n) - 1)).alias("value"), F.lit(n).alias("size")) for k, n in zip(lows, SEGMENTS, strict=True)]
    each = prints.select(F.explode(F.array(*cut)).alias("s")).groupBy("s.low", "s.value", "s.size").agg(F.count("*").alias("n"))
    counts = table(each)
    heavy = counts.where(F.col("n") * 2 > HOT)
    bits = heavy.select("low", "value", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("j"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))
    without = bits.select("low", "j", F.col("value").bitwiseAND(F.bitwise_not(one)).alias("rest")).distinct()
    both = without.select("low", "j", "rest", F.explode(F.array("rest", F.col("rest").bitwiseOR(one))).alias("value"))
    key = F.col("rest").bitwiseOR(F.call_function("shiftleft", (F.col("low") + F.col("j")).cast("long"), F.lit(32)))
    found = both.join(counts.select("low", "value", "n"), ["low", "value"]).groupBy(key.alias("key")).agg(F.sum("n").alias("n"))
    return table(found.where(F.col("n") > HOT))


def _met(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between fingerprints that share a key (keys sorted) and differ in few bits, as a spanning set."""
    left, right = [], []
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    of = np.repeat(size, size)
    for step in range(1, SMALL):
        i = np.flatnonzero((keys[step:] == keys[:-step]) & (of[step:] <= SMALL))
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= distance]
        left.append(fps[i])
        right.append(fps[i + step])
    for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        f = fps[at : at + n]
        rest = np.arange(n)
        while len(rest):  # breadth-first from the first that is left; each is visited once
            frontier, rest = [int(rest[0])], rest[1:]
            while frontier and len(rest):
                k = frontier.pop()
                near = np.bitwise_count(f[rest] ^ f[k]) <= distance
                found = rest[near]
                if len(found):
                    left.append(np.full(len(found), f[k]))
                    right.append(f[found])
                    frontier += found.tolist()
                    rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (src, dst) that connect distinct fingerprints (node long, fp long) at `distance` bits or fewer (at most 4).

    Directly or through others, any two such nodes are connected by the result. A row that travels to a meeting is the
    fingerprint and the bit that is struck out, from which its key is made on both sides; nodes are looked up for links alone.
    A variant that more than HOT fingerprints have is met in blocks, two by two, so that no task gets more than HOT of them.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the segments serve distances up to 4")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                fp = batch.slice(k, 4096).column("fp").to_numpy(zero_copy_only=False)
                # Bit by bit: then bits, which repeat, compress well whatever the number of partitions.
                yield pa.record_batch({"fp": pa.array(np.tile(fp, 64)), "bit": pa.array(np.repeat(np.arange(64, dtype=np.int32), len(fp)))})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            a, b = _met(t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64), distance)
            if len(a):
                pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0).view(np.int64)
                yield pa.record_batch({"src": pa.array(pair[:, 0]), "dst": pa.array(pair[:, 1])})

        for batch in batches:  # a key's rows may go on in the next batch: keep the last key's rows back
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                held.append(batch.slice(0, cut))
                yield from flush()
                held = []
            elif held and held[-1].column("key")[-1].as_py() != key[-1]:
                yield from flush()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flush()

    def linked(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions("key").mapInArrow(meet, "src long, dst long")

    keyed = prints.select("fp").mapInArrow(expand, "fp long, bit int")
    key = variant(F.col("fp"), F.col("bit"))
    hot = hot_variants(prints) if prints.count() > HOT else None  # fewer can't share a variant more often
    if hot is None or hot.isEmpty():
        found = linked(keyed.repartition(key).select(key.alias("key"), "fp"))
    else:
        named = keyed.select("fp", "bit", key.alias("key"))
        cold = named.join(carried(hot), "key", "left_anti").select("fp", "bit")
        blocks = F.ceil(F.col("n") / (HOT // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        split = named.join(carried(hot), "key").withColumn("blocks", blocks).select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        # Meetings that share this hash by chance are one: more is compared, nothing is missed.
        meeting = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        found = linked(cold.repartition(key).select(key.alias("key"), "fp")).unionByName(linked(split.select(meeting.alias("key"), "fp").repartition(F.col("key"))))
    pairs = found.distinct()
    for end in ("src", "dst"):
        pairs = pairs.withColumnRenamed(end, "fp").join(prints.select("fp", F.col("node").alias("own")), "fp").withColumnRenamed("own", end).drop("fp")
    return pairs.select("src", "dst")


def simhash_groups(docs: DataFrame, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, fp long, component_id) for each document; component_id is the smallest doc_id linked with it.

    Texts are read whole, lower-cased A-Z only, and cut at ASCII white space; with fewer than `width` words the whole
    sequence is the one shingle, with none the fingerprint is zero, linked like any other. Null texts count as empty.
    A document with a null identifier has the component of its fingerprint (null if no other document has it or is
    near it). Repeated rows stay. Other columns are ignored; an empty table gives no rows.
    """
    prints = table(fingerprints(docs, width, id_col, text_col))
    distinct = table(prints.groupBy("fp").agg(F.min("id").alias("node")))
    known = distinct.where("node is not null")
    found = table(components(links(known, distance)))
    named = table(distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component at 4 or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
