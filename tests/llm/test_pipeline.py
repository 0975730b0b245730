import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarrylane.llm import bpe, exact_dedup, near_copies, registry
from quarrylane.session import table


def test_every_operator_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(registry.ORACLES) <= set(names)


def test_stages_act_and_keep_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes, before = docs.columns, [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, sf))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] >= 0.8 * sizes[0] and sizes[2] < sizes[1]
    assert docs.where(F.col("text").rlike("@[A-Za-z0-9-]+[.][A-Za-z]")).count() == 0 and docs.where("n_chars <> length(text)").count() == 0
    assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    texts = docs.select(F.lower("text")).distinct().count()
    assert texts == docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.where("start = 0").count() == docs.count()


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns[:3] == ["doc_id", "start", "length"] and rows.count() > 0


@pytest.mark.parametrize("kind", ["edge", "empty"])
def test_stages_take_anything(spark, sf, request, kind):
    docs = request.getfixturevalue(kind)
    for _, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, sf))
    assert docs.count() > 0 if kind == "edge" else docs.count() == 0


def test_stages_write_no_text_again(spark, sf, monkeypatch):
    """Of Parquet files a row's place is its number: before, each of these stages wrote all texts with numbers first."""
    written = []
    for module in (corpus_pipeline, exact_dedup, near_copies):
        monkeypatch.setattr(module, "table", lambda df, path=None: (written.append(df.columns), table(df, path))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (corpus_pipeline.unique, corpus_pipeline.dissimilar):
        assert stage(spark, docs, sf).count() < docs.count()
    assert written and not [columns for columns in written if {"text", "norm"} & set(columns)]


def test_rows_of_files_are_numbered_by_place(spark, tmp_path):
    names = ["stage_row", "stage_path", "stage_file", "stage_place", "_metadata"]
    docs = spark.range(40).select("id", *[F.lit(7).alias(n) for n in names]).repartition(3)
    docs.write.parquet(f"{tmp_path}/a")
    once, twice = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/a")
    filtered, joined = once.where("id % 2 = 0"), once.join(spark.range(2).withColumnRenamed("id", "other"))
    for frame, n in ((once, 40), (twice, twice.count()), (filtered, 20), (joined, 80), (docs, 40), (once.limit(0), 0)):
        own, row = corpus_pipeline._numbered(frame)
        got = own.collect()
        assert own.columns == [*frame.columns, row] and len(got) == n == len({r[row] for r in got}) and all(r._metadata == 7 for r in got)
    own, row = corpus_pipeline._numbered(once)
    places = {r.id: r[row] for r in own.collect()}
    assert places == {r.id: r[row] for r in own.repartition(5).collect()} and len({v >> 40 for v in places.values()}) == 3


def test_deduplication_starts_no_other_python_workers(spark, sf, monkeypatch):
    """Rows from Python lists came through an RDD, for which each executor started a second Python daemon with two workers."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("rows went through Python workers"))
    assert 0 < corpus_pipeline.unique(spark, docs, sf).count() < docs.count()
    assert exact_dedup.DigestIndex(spark).compact().count() == 0


def test_stages_forget_what_the_worker_remembers():
    """A worker that had packed kept the vocabulary and 250,000 words through the other stages of the next table."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["One two three four five six.", "Seven"]
    ids = list(bpe.encode_packed(texts, path))
    assert bpe.packed_words.cache_info().currsize == bpe.codec.cache_info().currsize == 1
    rows = pa.record_batch({"row": pa.array([0, 1]), "id": pa.array([0, 1]), "text": pa.array(texts)})
    assert sum(b.num_rows for b in near_copies._sketch(iter([rows]))) == 2
    assert bpe.packed_words.cache_info().currsize == bpe.codec.cache_info().currsize == 0
    assert list(bpe.encode_packed(texts, path)) == ids
