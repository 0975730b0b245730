"""Operator 2, exact deduplication, as a log-structured merge index of digests. DataFrame operations only.

A memtable is what one input partition holds: flush() writes each as a run, sorted by digest, and for the batch a filter
on its digests. compact() merges the runs that aren't merged yet: a digest keeps one identifier (the smallest, or the
largest on request) and its count. lookup() asks filters before it joins: digests that none may hold pass by without a
shuffle. A digest only proposes: hits are then compared by the bytes of their texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.common import ascii_lower, shared_dir, table

#: The most 64-bit words of a filter, whose broadcast is 16 bytes a word; smaller ones have a word or two for each key. One
#: over more keys than words x 64 clears little and sends more rows to the joins, which decide anyway.
FILTER_WORDS = 1 << 20


def normalised(text: Column) -> Column:
    """What is compared: null as empty, A-Z lower-cased."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


class DigestIndex:
    """A log-structured merge index in a shared folder.

    Level 0 are runs of (digest binary, id long); a compaction merges those not yet merged, and the level before, into a new
    level of (digest, keep_id, n). Each run, and each level, has a filter on its digests. A level is written as a whole under
    a number of its own, so that a job that dies leaves the former level in place.
    """

    RUN = "digest binary, id long"
    #: What an index without rows has; as an Arrow table, since a list of rows would go through Python workers of its own.
    EMPTY = pa.table({"digest": pa.array([], pa.binary()), "keep_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest"):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.path, self.keep = spark, path or shared_dir(spark), keep
        self.flushed = self.compactions = 0
        self.runs: list[tuple[DataFrame, DataFrame, int]] = []  # not yet merged: rows, filter, its words
        self.level: DataFrame | None = None
        self.filter: tuple[DataFrame, int] | None = None
        self.merged: list[tuple[DataFrame, int]] = []  # the filters of the runs that the first level has

    def _filter(self, rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        words = filter_words(rows.count())
        return table(id_filter(rows.select(F.col("digest").alias("id")), words), f"{self.path}/filter/{name}"), words

    def flush(self, rows: DataFrame) -> DataFrame:
        """Write rows (digest, id) as sorted runs, one for each partition, without a shuffle, and their filter; returns them."""
        out = f"{self.path}/level0/batch={self.flushed}"
        rows.select("digest", "id").sortWithinPartitions("digest").write.parquet(out)
        run = self.spark.read.schema(self.RUN).parquet(out)
        self.runs.append((run, *self._filter(run, f"run={self.flushed}")))
        self.flushed += 1
        return run

    def compact(self) -> DataFrame:
        """Merge the runs that no level has yet with the level before; null identifiers count but aren't kept.

        Without such runs the level stays. Of the repeated digests the level's filter is made.
        """
        if self.runs or self.level is None:
            pick = F.min if self.keep == "smallest" else F.max
            merged = self.level if self.level is not None else self.spark.createDataFrame(self.EMPTY)
            for run, *_ in self.runs:
                merged = merged.unionByName(run.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n")))
            self.compactions += 1
            rows = merged.groupBy("digest").agg(pick("keep_id").alias("keep_id"), F.sum("n").alias("n")).sortWithinPartitions("digest")
            self.level = table(rows, f"{self.path}/level1/{self.compactions}")
            self.filter = self._filter(self.level, f"level={self.compactions}") if self.compactions > 1 else None
            self.merged, self.runs = [r[1:] for r in self.runs], []
        return self.level

    def filters(self) -> list[tuple[DataFrame, int]]:
        """The filters that hold all of the level's digests, each with its words: the level's own, or those of its runs."""
        return [self.filter] if self.filter else self.merged

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Rows (digest, ...) of a new batch whose digest the level has, with keep_id and n; the filter is asked before the join."""
        if self.level is None:
            return rows.join(self.compact(), "digest")
        maybe, _ = split(rows, self.filters(), F.col("digest"))
        return maybe.join(self.level, "digest")

    def repeated(self, run: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A run's rows that may have a digest of several rows, and those that certainly don't, told by a filter without a shuffle."""
        return split(run, [self._filter(self.level.where("n > 1"), f"repeated={self.compactions}")], F.col("digest"))


def split(rows: DataFrame, filters: list[tuple[DataFrame, int]], key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose key some of the filters may hold, and rows whose key none holds. Filters are broadcast: their size is bounded."""
    held, at, bits = (unused(rows, x) for x in ("filter_held", "filter_word", "filter_bits"))
    probed = rows.withColumn(held, F.lit(False))
    for filt, words in filters:
        word, bit = _place(words, key)
        f = F.broadcast(filt.select(F.col("word").alias(at), F.col("bits").alias(bits)))
        hit = F.col(held) | F.coalesce(bit.bitwiseAND(F.col(bits)) != 0, F.lit(False))
        probed = probed.join(f, word == F.col(at), "left").withColumn(held, hit).drop(at, bits)
    return probed.where(F.col(held)).drop(held), probed.where(~F.col(held)).drop(held)


def filter_words(keys: int) -> int:
    """Words of a filter over so many keys: a power of two, at most FILTER_WORDS."""
    return min(FILTER_WORDS, 1 << max(6, keys.bit_length()))


def _place(words: int, key: Column) -> tuple[Column, Column]:
    """Where the filter has an id: the word and the bit in it."""
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int"))


def id_filter(ids: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """A one-hash Bloom filter over ids as rows (word, bits): at most `words` rows, whatever the number of ids."""
    word, bit = _place(words, F.col("id"))
    return ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def may_hold(rows: DataFrame, filt: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Rows (id, ...) that the filter may hold; the filter is broadcast (its size has the bound `words`)."""
    word, bit = _place(words, F.col("id"))
    probe = rows.withColumn("_word", word).withColumn("_bit", bit)
    f = F.broadcast(filt.select(F.col("word").alias("_at"), F.col("bits").alias("_bits")))
    return probe.join(f, (F.col("_word") == F.col("_at")) & (F.col("_bit").bitwiseAND(F.col("_bits")) != 0), "left_semi").drop("_word", "_bit")


def drop_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose identifier is in dropped (id); null identifiers stay.

    Rows that a bounded filter clears pass where they are; only the rest is shuffled and compared with dropped.
    """
    gone = table(dropped.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct())
    words = filter_words(gone.count())
    filt = table(id_filter(gone, words))
    own = F.col(id_col).cast("long")
    word, bit = _place(words, own)
    at, bits, known = (unused(docs, x) for x in ("filter_word", "filter_bits", "gone"))
    f = F.broadcast(filt.select(F.col("word").alias(at), F.col("bits").alias(bits)))
    probed = docs.join(f, (word == F.col(at)) & (bit.bitwiseAND(F.col(bits)) != 0), "left")
    clear = probed.where(F.col(at).isNull()).select(*docs.columns)
    rest = probed.where(F.col(at).isNotNull()).join(gone.withColumnRenamed("id", known), own == F.col(known), "left_anti").select(*docs.columns)
    return clear.unionByName(rest)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df hasn't."""
    while name in df.columns:
        name += "_"
    return name


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", digest=sha) -> DataFrame:
    """Groups of equal texts: a row (doc_id, digest, keep_id, group_size, kept) for each row of docs.

    Equal means the same bytes after null became empty and A-Z became a-z. Rows that repeat an identifier are counted
    each, and those with the kept identifier are all kept; a null identifier is never kept unless its whole group has
    none. Empty tables give no rows; other columns of docs are ignored. `digest` may be replaced (tests use a short
    one): texts that differ under one digest are told apart by their bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    index = DigestIndex(spark, keep=keep)
    runs = index.flush(rows.select("id", F.unhex(digest(F.col("norm"))).alias("digest")))
    level = index.compact()
    repeated = level.where("n > 1")
    maybe, alone = index.repeated(runs)  # most digests are one row's alone: those rows don't take part in any join
    # Byte verification: texts of hits only, found by a bounded filter on identifiers and grouped whole.
    hits = maybe.join(repeated, "digest").select("id")
    words = filter_words(repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    suspects = may_hold(raw, table(id_filter(hits, words)), words).withColumn("norm", normalised(F.col("text")))
    pick = F.min if keep == "smallest" else F.max
    texts = suspects.select(F.unhex(digest(F.col("norm"))).alias("digest"), "norm", "id").groupBy("digest", "norm").agg(pick("id").alias("keep_id"), F.count("*").alias("n"))
    distinct = texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    collided = table(distinct)
    out = maybe.join(level, "digest")
    if not collided.isEmpty():  # different texts under one digest: group those by their bytes
        apart = texts.join(collided, "digest", "left_semi")
        again = rows.select("id", F.unhex(digest(F.col("norm"))).alias("digest"), "norm").join(collided, "digest", "left_semi")
        out = out.join(collided, "digest", "left_anti").unionByName(again.join(apart, ["digest", "norm"]).select("digest", "id", "keep_id", "n"))
    out = out.unionByName(alone.select("digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n")))
    return out.select(
        F.col("id").alias(id_col), F.lower(F.hex("digest")).alias("digest"), "keep_id", F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the group of its text; of equal texts the largest doc_id stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
