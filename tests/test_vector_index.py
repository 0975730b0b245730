"""The vector index against exact search."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylane.plans import retrieval, vector_index
from quarrylane.session import shared_dir
from quarrylane.sources.entities import table


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 24))
    v = middle[rng.integers(0, 12, 6000)] + rng.normal(size=(6000, 24))
    data = [(i, x.tolist(), float(i % 16), ["Austin", "Berlin", "Remote"][i % 3]) for i, x in enumerate(v)]
    return spark.createDataFrame(data, "doc_id long, embedding array<float>, years double, place string").cache()


@pytest.fixture(scope="module")
def index(spark, rows):
    return vector_index.build_index(rows, shared_dir(spark), ["years", "place"])


def queries(rows):
    return rows.where("doc_id % 97 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))


def recall(found, exact):
    got = {(r.query_id, r.doc_id) for r in found.collect()}
    want = {(r.query_id, r.doc_id) for r in exact.collect()}
    return len(got & want) / len(want)


FILTERS = {
    "none": (None, "true"), "years": (lambda a: a["years"] >= 8, "years >= 8"), "few": (lambda a: (a["years"] == 3) & (a["place"] == "Berlin"), "years = 3 and place = 'Berlin'"),
    "text": (lambda a: a["place"].ilike("%berl%") | a["place"].ilike("%remote%"), "place <> 'Austin'"),
}


@pytest.mark.parametrize("name", FILTERS)
def test_recall_with_and_without_filters(rows, index, name):
    where, sql = FILTERS[name]
    exact = retrieval.dense_search(rows.where(sql), queries(rows), 10)
    found = vector_index.nearest(index, queries(rows), 10, where)
    assert recall(found, exact) >= 0.95
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {10}
    scores = found.join(exact.select("query_id", "doc_id", F.col("score").alias("s")), ["query_id", "doc_id"])
    assert scores.where(F.abs(F.col("score") - F.col("s")) > 1e-6).count() == 0


def test_graphs_alone_find_nearly_all(rows):
    v = vector_index.unit(np.array([r.embedding for r in rows.select("embedding").collect()], np.float32))
    links, q = vector_index.graph(v), v[::50]
    every = np.ones(len(v), bool)
    for passing in (every, np.arange(len(v)) % 3 == 0):
        row, node, _ = vector_index.walk(v, links, passing, q, 10)
        sim = np.where(passing, q @ v.T, -np.inf)
        want = {(i, j) for i, best in enumerate(np.argsort(-sim, axis=1, kind="stable")[:, :10]) for j in best.tolist()}
        assert len(want & set(zip(row.tolist(), node.tolist()))) / len(want) >= 0.95 and passing[node].all()


def test_index_is_opened_and_extended(spark, rows):
    path = shared_dir(spark)
    vector_index.build_index(rows.where("doc_id < 4000"), path, ["years", "place"])
    opened = vector_index.open_index(spark, path)
    assert opened.attributes == ["years", "place"]
    for _ in range(2):  # the second time adds nothing
        grown = vector_index.extend_index(vector_index.open_index(spark, path), rows.where("doc_id >= 3500"))
    ids = [i for r in grown.shards.select("ids").collect() for i in r.ids]
    assert sorted(ids) == list(range(6000))
    assert recall(vector_index.nearest(grown, queries(rows), 10), retrieval.dense_search(rows, queries(rows), 10)) >= 0.95


def test_odd_vectors_and_queries(spark):
    data = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 1.0]), (4, [1.0, 2.0, 3.0]), (5, [0.0, 1.0])]
    built = vector_index.build_index(spark.createDataFrame(data, "doc_id long, embedding array<float>").coalesce(1), shared_dir(spark))
    asked = spark.createDataFrame([(1, [2.0, 0.1]), (2, None), (3, [1.0]), (None, [1.0, 0.0])], "query_id long, vector array<float>")
    got = [(r.query_id, r.doc_id, r["rank"]) for r in vector_index.nearest(built, asked, 2).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (1, 5, 2)]
    none = vector_index.build_index(spark.createDataFrame([], "doc_id long, embedding array<float>"), shared_dir(spark))
    assert vector_index.nearest(none, spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>"), 2).count() == 0


def test_given_vectors(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    built = vector_index.build_index(vectors, shared_dir(spark), ["label"])
    asked = vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert recall(vector_index.nearest(built, asked, 10), retrieval.dense_search(vectors, asked, 10)) >= 0.95


def test_exact_search_is_tiled():
    """A task's memory doesn't grow with the queries of a block but for their best; a tile's border changes nothing."""
    rng = np.random.default_rng(6)
    v, q = rng.normal(size=(2100, 8)), rng.normal(size=(2000, 8))
    v[7:9], q = 0, q / np.linalg.norm(q, axis=1, keepdims=True)
    rows = pa.record_batch({"doc_id": pa.array(np.arange(2100)), "v": pa.array(v.tolist(), pa.list_(pa.float64()))})
    tracemalloc.start()
    ((ids, best),) = retrieval.nearest_of(iter([rows.slice(0, 1500), rows.slice(1500)]), q, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    norm = np.linalg.norm(v, axis=1)
    score = (q @ v.T / np.where(norm == 0, 1, norm)).round(9)
    order = np.lexsort((np.broadcast_to(np.arange(2100), score.shape), -score), axis=1)[:, :5]
    assert (ids == order).all() and np.abs(best - np.take_along_axis(score, order, 1)).max() < 1e-8
    assert peak < 20 << 20  # one array of all the queries by 1,024 vectors has 16 MB, and six were held
