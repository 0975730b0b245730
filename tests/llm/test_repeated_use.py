"""Indexes that are used again and again, words made to collide, columns that clash."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylane.llm import exact_dedup
from quarrylane.llm.language_model import sequences


def test_three_compactions_count_each_row_once(spark):
    rows = spark.range(60).select(F.sha2((F.col("id") % 7).cast("string"), 256).alias("d"), "id").select(F.unhex("d").alias("digest"), "id")
    for keep, pick in (("smallest", min), ("largest", max)):
        index = exact_dedup.DigestIndex(spark, keep=keep)
        for low, high in ((0, 20), (20, 21), (21, 50), (50, 60)):
            index.flush(rows.where((F.col("id") >= low) & (F.col("id") < high)))
            if high != 50:  # two runs are merged at once in the end
                index.compact()
        again = index.compact()
        want = {}
        for r in rows.collect():
            want.setdefault(bytes(r.digest), []).append(r.id)
        assert {bytes(r.digest): (r.keep_id, r.n) for r in again.collect()} == {d: (pick(ids), len(ids)) for d, ids in want.items()}
        assert index.compact().count() == 7 and index.runs == []


def test_lookup_passes_columns_and_finds_only_known_digests(spark):
    rows = spark.range(500).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    index = exact_dedup.DigestIndex(spark)
    index.flush(rows.where("id < 200"))
    for _ in range(2):
        index.compact()
        asked = rows.where("id >= 150").select("digest", F.col("id").alias("filter_word"), F.lit(1).alias("filter_bits"), F.lit(2).alias("filter_held"))
        found = index.lookup(asked)
        assert {r.filter_word for r in found.collect()} == set(range(150, 200 if index.compactions == 1 else 300))
        index.flush(rows.where("id >= 200 and id < 300"))


def test_an_empty_index_finds_nothing(spark):
    index = exact_dedup.DigestIndex(spark)
    assert index.lookup(spark.range(3).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))).count() == 0


def test_words_of_thue_and_morse_are_told_apart():
    bits = [i.bit_count() % 2 for i in range(1 << 12)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    for n in (64, 1024, 1 << 12):
        seq, counts = sequences([f"{one[:n]} {two[:n]} {one[:n]}"])
        words = seq[1:-1]
        assert counts.tolist() == [4] and words[0] == words[2] != words[1]


def test_words_of_all_lengths_are_told_apart():
    words = [c * n for c in "abc" for n in range(1, 300)]
    seq, _ = sequences([" ".join(words)])
    assert len(np.unique(seq[1:-1])) == len(words)


def test_stages_keep_columns_whatever_their_names(spark):
    names = ["stage_row", "stage_row_", "_stage_row", "row", "keep", "word", "filter_word", "gone"]
    docs = spark.createDataFrame([(i, f"text number {i // 2} with some more words in it", *range(len(names))) for i in range(6)], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    for stage in (corpus_pipeline.unique, corpus_pipeline.dissimilar):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 4]
        assert all(tuple(r)[2:] == tuple(range(len(names))) for r in out.collect())
