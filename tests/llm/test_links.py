"""Links that must not be lost: at a cosine's limit, across lists, in hot groups; and digests that filters clear."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.llm import embedding_dedup, exact_dedup, near_copies, simhash
from quarrylane.llm.common import components
from tests.llm.conftest import by_id
from tests.llm.test_dedup import union_find


def brute(x, least=0.95):
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1)[:, None]
    link = unit @ unit.T >= least
    np.fill_diagonal(link, False)
    return link


def test_op5_is_whole_on_the_given_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    good = [r for r in rows if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    link = brute(np.array([r.embedding for r in good]))
    roots = union_find(len(good), zip(*np.nonzero(link), strict=True))
    low = {}
    for r, root in zip(good, roots, strict=True):
        low[root] = min(low.get(root, r.vec_id), r.vec_id)
    want = {r.vec_id: (0, r.vec_id, True) for r in rows} | {r.vec_id: (int(n), low[root], low[root] == r.vec_id) for r, n, root in zip(good, link.sum(1), roots, strict=True)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.op5_embedding_dedup(spark, sf).collect()}
    assert got == want


def at_the_limit(rng, n, d, few=None):
    """Pairs at a cosine just over 0.95; their offsets in all directions, or in a few components."""
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o = rng.normal(size=(n, d))
    if few:
        o *= np.argsort(rng.random((n, d)), axis=1) < few
    o -= (o * x).sum(1)[:, None] * x
    o /= np.linalg.norm(o, axis=1)[:, None]
    y = x * 0.9502 + o * np.sqrt(1 - 0.9502**2)
    return np.concatenate([x, y]).astype("f4")


@pytest.mark.parametrize("d, few, reach, least", [(24, None, 4.0, 1.0), (64, None, 4.0, 1.0), (64, 2, None, 1.0), (64, 2, 4.0, 0.99)])
def test_op5_links_at_the_limit(spark, d, few, reach, least):
    x = at_the_limit(np.random.default_rng(d), 1500, d, few)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = by_id(embedding_dedup.embedding_groups(rows, reach=reach), "vec_id")
    link = brute(x)
    have = sum(r.n_links for r in got.values())
    assert least * link.sum() <= have <= link.sum() and link.sum() >= 3000
    if least == 1:
        assert [got[i].n_links for i in range(len(x))] == link.sum(1).tolist()


def test_op5_lengths_and_doubles(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.01]), (5, [1e-200, 0.0]), (6, [1e300, 1e298]), (7, [0.0, 1.0, 0.0, 0.0])]
    got = by_id(embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id")
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == {1: (1, 1), 2: (1, 1), 3: (3, 3), 4: (3, 3), 5: (3, 3), 6: (3, 3), 7: (0, 7)}


def test_op5_blocks_of_long_lists(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=8) + rng.normal(size=(300, 8)) * 0.2).astype("f4")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = by_id(embedding_dedup.embedding_groups(rows, reach=None), "vec_id")
    assert [got[i].n_links for i in range(300)] == brute(x).sum(1).tolist()


def test_op9_hot_variants_are_met_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    top, fps = rng.getrandbits(22) << 42, set()
    while len(fps) < 700:  # one segment is the same in all, so that its variants are
        base = top | rng.getrandbits(42)
        fps |= {base, base ^ 1 << rng.randrange(64), base ^ 1 << rng.randrange(42) ^ 1 << rng.randrange(42)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "HOT", 64)
    rows = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "node long, fp long")
    got = {r.node: r.component for r in components(simhash.links(rows)).collect()}
    roots = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [got.get(i, i) for i in range(len(fps))] == roots and len(set(roots)) < len(fps)


def test_op9_hot_variants_are_told_by_values(spark, monkeypatch):
    """Keys above HOT are found from counts of segment values; before, all 64 keys of every fingerprint were counted."""
    rng = random.Random(9)
    fps = sorted({rng.getrandbits(64) & (1 << 22) - 1 - (1 << rng.randrange(12)) | rng.choice((0, 5, 4)) << 43 | rng.choice((1, 3)) << 22 | rng.getrandbits(10) << 54 for _ in range(600)})
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    low, want = 0, {}
    for size in simhash.SEGMENTS:
        for j in range(size):
            for x in fps:
                key = x >> low & (1 << size) - 1 & ~(1 << j) | low + j << 32
                want[key] = want.get(key, 0) + 1
        low += size
    keys = rows.select(F.explode(F.array(*[simhash.variant(F.col("fp"), F.lit(k)) for k in range(64)])).alias("key"))
    assert {r.key: r["count"] for r in keys.groupBy("key").count().collect()} == want
    for most in (8, 100):
        monkeypatch.setattr(simhash, "HOT", most)
        got = {r.key: r.n for r in simhash.hot_variants(rows).collect()}
        assert got == {k: n for k, n in want.items() if n > most} and got


def test_near_copies_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 9999, 200)]
    texts = []
    for _ in range(60):
        words = list(base)
        words[rng.integers(200)] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    got = near_copies.near_copies(docs, "row").collect()
    assert len(got) == 60 and {r.keep for r in got} == {0}


def test_op2_lookup_asks_the_filters(spark, documents):
    digest = F.unhex(exact_dedup.sha(exact_dedup.normalised(F.col("text"))))
    rows = documents.select(F.col("doc_id").alias("id"), digest.alias("digest"), "source")
    index = exact_dedup.DigestIndex(spark)
    index.flush(rows.where("id % 3 = 0"))
    index.flush(rows.where("id % 3 = 1"))
    index.compact()
    new = rows.where("id % 3 = 2")
    have = {bytes(r.digest) for r in rows.where("id % 3 < 2").collect()}
    got = index.lookup(new).collect()
    assert sorted(r.id for r in got) == sorted(r.id for r in new.collect() if bytes(r.digest) in have) and len(got) > 0
    assert "BroadcastHashJoin" in index.lookup(new)._jdf.queryExecution().executedPlan().toString() and len(index.filters()) == 2
    foreign = spark.range(1000).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    for filt, words in index.filters():  # nearly all digests that no run has are cleared before the join
        assert exact_dedup.may_hold(foreign.select(F.col("digest").alias("id")), filt, words).count() < 100


def test_drop_ids_takes_any_column_names(spark):
    docs = spark.createDataFrame([(1, 5, 6, 7), (2, 5, 6, 7)], "doc_id long, filter_word int, filter_bits int, gone int")
    left = exact_dedup.drop_ids(docs, spark.createDataFrame([(1,)], "id long"))
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, 5, 6, 7)]


def test_pipeline_stages_tell_rows_apart(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "A text"), (2, "a Text"), (2, "quite another one"), (None, "a text"), (1, "A text"), (None, None), (3, "")], "doc_id long, text string")
    left = sorted((r.text or "").lower() for r in corpus_pipeline.unique(spark, docs, "").collect())
    assert left == ["", "a text", "quite another one"]
