import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylane.llm import embedding_dedup, exact_dedup, simhash
from quarrylane.llm.common import components
from tests.llm.conftest import by_id

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_against_brute_force(spark, sf, texts):
    got = by_id(exact_dedup.op2_exact_dedup(spark, sf))
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[t.translate(FOLD)].append(k)
    assert set(got) == set(texts)
    for t, ids in groups.items():
        for k in ids:
            r = got[k]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), k == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_edges(edge, empty):
    got = [tuple(r) for r in exact_dedup.exact_dedup(edge).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert len(got) == 13
    assert {(1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False), (6, 6, 3, True)} <= set(got)
    assert got.count((7, 6, 3, False)) == 2  # a repeated row; Ä isn't folded, G is
    assert {(3, 3, 3, True), (4, 3, 3, False), (None, 3, 3, False)} <= set(got)  # null and empty are one text
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_tells_colliding_digests_apart(documents):
    short = lambda text: F.substring(exact_dedup.sha(text), 1, 2)  # noqa: E731  8 bits: collisions everywhere
    same = exact_dedup.exact_dedup(documents, "largest").select("doc_id", "keep_id", "group_size", "kept")
    told = exact_dedup.exact_dedup(documents, "largest", digest=short).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(same.collect()) == sorted(told.collect())


def test_index_grows_by_batches(spark, documents):
    index = exact_dedup.DigestIndex(spark)
    rows = documents.select(F.col("doc_id").alias("id"), F.unhex(exact_dedup.sha(exact_dedup.normalised(F.col("text")))).alias("digest"))
    index.flush(rows.where("id % 2 = 0"))
    index.flush(rows.where("id % 2 = 1"))
    level = index.compact()
    whole = rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    assert sorted(level.collect()) == sorted(whole.collect())
    assert index.lookup(rows.limit(5)).count() == 5


def test_drop_ids_keeps_all_columns(edge):
    gone = edge.where("doc_id in (1, 7)").select(F.col("doc_id").alias("id"))
    left = exact_dedup.drop_ids(edge, gone)
    assert left.columns == edge.columns and left.count() == 10 and {r.id for r in left.collect()} == {7}


def test_native_plan(spark, sf):
    plan = exact_dedup.op2_exact_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def slow_fingerprint(text, width):
    words = text.translate(FOLD).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash_against_brute_force(spark, sf, texts):
    got = by_id(simhash.op9_simhash(spark, sf))
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[k], 4) for k in ids]
    assert [got[k].fingerprint for k in ids] == [f"{x:016x}" for x in fps]
    roots = union_find(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [got[k].component_id for k in ids] == [ids[r] for r in roots]
    assert len(set(roots)) < len(ids)


@pytest.mark.parametrize("size", [60, 3])
def test_simhash_links_are_whole(spark, size):
    """Fingerprints in dense and thin groups, all distances: components as from all pairs."""
    rng = random.Random(size)
    fps = set()
    while len(fps) < 400:
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)]
    got = {r.node: r.component for r in components(simhash.links(spark.createDataFrame(rows, "node long, fp long"))).collect()}
    roots = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [got.get(i, i) for i in range(len(fps))] == roots


def test_simhash_edges(edge, empty):
    rows = simhash.simhash_groups(edge).collect()
    assert len(rows) == 13
    got = {r.doc_id: r for r in rows}
    assert got[3].fp == got[4].fp == got[9].fp == 0 and got[9].component_id == 3
    assert got[1].component_id == got[2].component_id == 1 and got[7].component_id in (6, 7)
    assert {r.component_id for r in rows if r.doc_id is None} == {1, 3}
    assert simhash.simhash_groups(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and len(got) == 71
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 24)).astype("f4")
    near = base[:150] + rng.normal(size=(150, 24)).astype("f4") * 0.15
    chain = np.stack([np.cos(np.arange(12) * 0.25), np.sin(np.arange(12) * 0.25)], 1) @ np.eye(2, 24)
    x = np.concatenate([base, near, base[:20], base[20:40] * 3, chain]).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = by_id(embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "vec_id")
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    want, have = link.sum(), sum(r.n_links for r in got.values())
    assert have <= want and have >= 0.98 * want
    roots = union_find(len(x), zip(*np.nonzero(link), strict=True))
    assert np.mean([got[i].component_id == roots[i] for i in range(len(x))]) > 0.98


def test_embeddings_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0], 0), (9, [], 0), (10, [0.0, 1.0], 0), (10, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (11, [-1.0, 0.0], 0)]
    got = sorted((tuple(r) for r in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int")).collect()), key=str)
    want = [(1, 2, 1), (2, 2, 1), (None, 2, 1), (10, 1, 10), (10, 1, 10), (11, 0, 11), *[(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9)]]
    assert got == sorted(want, key=str)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_groups(none).count() == 0
