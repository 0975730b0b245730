"""An index for filtered nearest-neighbour search: inverted lists of shards, in each a navigable small-world graph.

A row of the index is a shard: up to about SHARD vectors of one list, their graph and their attributes, so that a task
has a graph whole, without a shuffle. A search asks the lists nearest to each query, as many as it takes for enough
vectors that pass the filter, and walks the graphs: every node leads on, only those that pass the filter are results.
Filters run as column expressions over the shards' attributes, before anything goes to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.plans.lexical import top
from quarrylane.session import table

#: Vectors of a shard, by number and by bytes; links of a node to its nearest and to any others.
SHARD, SHARD_BYTES, NEAR, FAR = 8192, 32 << 20, 24, 4
#: Vectors that centroids are fitted on, the most centroids, rounds of fitting.
SAMPLE, LISTS, ROUNDS = 20_000, 4096, 8
#: Lists that are asked at least, and vectors passing the filter in them, as a multiple of k.
PROBES, ENOUGH = 8, 40
#: The share of the nearest TUNED_K of TUNED_ON sampled vectors that has to be in the lists asked.
TUNED, TUNED_ON, TUNED_K = 0.985, 400, 10
#: Nodes that a walk keeps; below this share of passing nodes they are compared one by one instead.
BEAM, SCANNED = 96, 0.2
#: Queries of one pass.
QUERY_BLOCK = 4096
#: Queries, or nodes to be linked, that a task compares with a shard at once.
QUERIES = 256


def unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means over unit vectors; empty centroids start anew from a vector."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([(sample[k : k + 4096] @ found.T).argmax(1) for k in range(0, len(sample), 4096)])
        total = np.zeros_like(found)
        np.add.at(total, own, sample)
        empty = np.bincount(own, minlength=lists) == 0
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        found = unit(total)
    return found


def tuned_probes(sample: np.ndarray, found: np.ndarray) -> int:
    """How many of the nearest lists have to be asked, by the exact neighbours of some sampled vectors among all of them.

    Where there are more vectors than the sample has, neighbours are nearer, so that this is on the safe side.
    """
    q = sample[:: max(1, len(sample) // TUNED_ON)]
    own = np.concatenate([(sample[k : k + 4096] @ found.T).argmax(1) for k in range(0, len(sample), 4096)])
    k = min(TUNED_K, len(sample))
    near = np.argpartition(-(q @ sample.T), k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ found.T), axis=1, kind="stable"), axis=1)  # of each list for each vector
    return max(PROBES, int(np.quantile(np.take_along_axis(place, own[near], 1), TUNED, method="higher")) + 1)


def graph(v: np.ndarray, near: int = NEAR, far: int = FAR) -> np.ndarray:
    """Links (n, 2 near + far) of unit vectors, -1 where there is none: nearest others, those that have it as such, and some at random."""
    n = len(v)
    out = np.full((n, 2 * near + far), -1, np.int32)
    if n < 2:
        return out
    many = min(near, n - 1)
    nearest = np.zeros((n, many), np.int32)
    for k in range(0, n, QUERIES):
        sim = v[k : k + QUERIES] @ v.T
        sim[np.arange(len(sim)), np.arange(k, k + len(sim))] = -np.inf
        nearest[k : k + QUERIES] = np.argpartition(-sim, many - 1, axis=1)[:, :many]
    out[:, :many] = nearest
    to, by = nearest.reshape(-1), np.repeat(np.arange(n), many)
    order = np.argsort(to, kind="stable")
    to, by = to[order], by[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    some = place < near
    out[to[some], near + place[some]] = by[some]
    out[:, 2 * near :] = np.random.default_rng(n).integers(0, n, (n, far))
    return out


def walk(v: np.ndarray, links: np.ndarray, passing: np.ndarray, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of q up to k of the nearest nodes that pass: (row of q, node, cosine). All queries step at once."""
    n, share = len(v), passing.mean() if len(v) else 0.0
    if share == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    if share < SCANNED or n <= 4 * beam:
        own = np.flatnonzero(passing)
        sim = q @ v[own].T
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        return np.repeat(np.arange(len(q)), best.shape[1]), own[best].reshape(-1), np.take_along_axis(sim, best, 1).reshape(-1)
    beam = min(n, int(max(beam, 2 * k) / share))
    every = np.arange(len(q))
    entry = np.linspace(0, n - 1, min(n, 16)).astype(np.int64)
    node = np.full((len(q), beam), -1)
    sim = np.full((len(q), beam), -np.inf)
    done = np.ones((len(q), beam), bool)
    start = q @ v[entry].T
    keep = min(beam, len(entry))
    order = np.argsort(-start, axis=1)[:, :keep]
    node[:, :keep], sim[:, :keep], done[:, :keep] = entry[order], np.take_along_axis(start, order, 1), False
    seen = np.zeros((len(q), n), bool)
    seen[:, entry] = True
    live = every
    while len(live):
        waiting = np.where(done[live], -np.inf, sim[live])
        at = waiting.argmax(1)
        some = waiting[np.arange(len(live)), at] > -np.inf
        live, at = live[some], at[some]
        if not len(live):
            break
        done[live, at] = True
        near = links[node[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.maximum(near, 0)] |= near >= 0
        new = np.where(fresh, np.einsum("qmd,qd->qm", v[near], q[live]), -np.inf)
        # A neighbour that stands twice in a node's links counts once.
        order = np.argsort(near, axis=1, kind="stable")
        twice = np.zeros_like(fresh)
        lined = np.take_along_axis(near, order, 1)
        np.put_along_axis(twice, order[:, 1:], lined[:, 1:] == lined[:, :-1], 1)
        new[twice] = -np.inf
        all_sim = np.concatenate([sim[live], new], axis=1)
        all_node, all_done = np.concatenate([node[live], near], axis=1), np.concatenate([done[live], ~np.isfinite(new)], axis=1)
        best = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        sim[live], node[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_sim, all_node, all_done))
    ok = np.isfinite(sim) & passing[np.maximum(node, 0)]
    order = np.argsort(np.where(ok, -sim, np.inf), axis=1, kind="stable")[:, :k]
    found = np.take_along_axis(ok, order, 1)
    return np.repeat(every, order.shape[1])[found.reshape(-1)], np.take_along_axis(node, order, 1)[found], np.take_along_axis(sim, order, 1)[found]


@dataclass
class VectorIndex:
    """Shards (list, n, ids, vectors, links, attributes) at a path, and the centroids of the lists."""

    path: str
    shards: DataFrame
    centroids: np.ndarray
    attributes: list[str]
    probes: int


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _sharded(rows: DataFrame, held, dim: int, attributes: list[str]) -> DataFrame:
    """Shards of rows (id, embedding, attributes)."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (unit(_vectors(batch.column("embedding"), dim)) @ held.value.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield batch.append_column("list", pa.array(near.astype(np.int32)))

    placed = table(rows.mapInArrow(assigned, f"{rows._jdf.schema().toDDL()}, list int"))
    most = max(1, min(SHARD, SHARD_BYTES // (4 * dim)))
    size = placed.groupBy("list").agg(F.ceil(F.count("*") / most).alias("parts"))  # as many rows as lists, at most
    split = placed.join(F.broadcast(size), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    own = split.select("list", "part", "id", "embedding", F.struct(*attributes).alias("a") if attributes else F.lit(None).cast("struct<none:int>").alias("a"))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def shard(rows: pa.Table) -> pa.RecordBatch:
            v = unit(_vectors(rows.column("embedding").combine_chunks(), dim))
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            attrs = rows.column("a").combine_chunks()
            return pa.record_batch({
                "list": rows.column("list").combine_chunks().slice(0, 1), "n": pa.array([len(rows)], pa.int32()),
                "ids": one(rows.column("id").to_pylist(), pa.int64()), "vectors": one(v.reshape(-1), pa.float32()),
                "links": one(graph(v).reshape(-1), pa.int32()), "attributes": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), attrs),
            })

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*(rest.to_batches() if rest is not None else ()), batch])
            key = rows.column("list").to_numpy().astype(np.int64) << 32 | rows.column("part").to_numpy()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist()
            for a, b in zip(first[:-1], first[1:], strict=True):
                yield shard(rows.slice(a, b - a))
            rest = rows.slice(first[-1])
        if rest is not None:
            yield shard(rest)

    kind = own.schema["a"].dataType.simpleString()
    return own.repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(built, f"list int, n int, ids array<bigint>, vectors array<float>, links array<int>, attributes array<{kind}>")


def _sound(vectors: DataFrame, id_col: str, vector_col: str, attributes: list[str], dim: int | None = None) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"), *attributes).where("id is not null and embedding is not null")
    return rows.where(F.size("embedding") == dim) if dim else rows


def build_index(vectors: DataFrame, path: str, attributes: list[str] | None = None, id_col: str = "doc_id", vector_col: str = "embedding") -> VectorIndex:
    """Write an index of vectors and of the attributes that filters may ask for.

    Centroids, as many as the root of the number of vectors (at most LISTS), are fitted on at most about SAMPLE of them; every
    vector is in the index. Null vectors, and vectors of another length than the first, are left out.
    """
    spark, attributes = vectors.sparkSession, attributes or []
    rows = _sound(vectors, id_col, vector_col, attributes)
    one = rows.first()
    dim = len(one.embedding) if one else 1
    rows = rows.where(F.size("embedding") == dim)
    n = rows.count()
    some = rows.select("embedding") if n <= SAMPLE else rows.select("embedding").sample(SAMPLE / n, 11)
    sample = unit(np.array([r.embedding for r in some.collect()] or np.zeros((1, dim)), np.float32).reshape(-1, dim))
    found = centroids(sample, int(np.clip(np.sqrt(n), 1, min(LISTS, len(sample)))))
    probes = tuned_probes(sample, found)
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(found)], "list int, centroid array<float>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    _sharded(rows, spark.sparkContext.broadcast(found), dim, attributes).write.mode("overwrite").parquet(f"{path}/shards")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    shards = spark.read.parquet(f"{path}/shards")
    names = shards.schema["attributes"].dataType.elementType.names
    return VectorIndex(path, shards, np.array([r.centroid for r in rows], np.float32), [] if names == ["none"] else names, rows[0].probes)


def extend_index(index: VectorIndex, vectors: DataFrame, id_col: str = "doc_id", vector_col: str = "embedding") -> VectorIndex:
    """Add vectors as shards of their own; identifiers that the index has are left as they are."""
    spark = vectors.sparkSession
    known = index.shards.select(F.explode("ids").alias("id"))
    rows = _sound(vectors, id_col, vector_col, index.attributes, index.centroids.shape[1]).join(known, "id", "left_anti")
    new = table(_sharded(rows, spark.sparkContext.broadcast(index.centroids), index.centroids.shape[1], index.attributes))
    new.write.mode("append").parquet(f"{index.path}/shards")
    return open_index(spark, index.path)


def nearest(index: VectorIndex, queries: DataFrame, k: int = 10, where: Callable[[Column], Column] | None = None, probes: int | None = None) -> DataFrame:
    """About the k nearest vectors (query_id, doc_id, score, rank) of queries (query_id long, vector) by cosine.

    `where` makes of a row's attributes (a struct) whether it may be found. Queries that are null, or of another length, find
    nothing. More than QUERY_BLOCK queries are several passes over the index. `probes` lists are asked at least, by default as
    many as the index was tuned to; retrieval.dense_search() is exact.
    """
    probes = probes or index.probes
    dim = index.centroids.shape[1]
    asked = queries.where("query_id is not null and vector is not null").where(F.size("vector") == dim).select(F.col("query_id").cast("long"), F.col("vector").cast("array<float>"))
    passing = F.transform("attributes", lambda a: F.coalesce(where(a), F.lit(False))) if where else F.transform("ids", lambda _: F.lit(True))
    rows = index.shards.withColumn("passing", passing)
    per_list = {r["list"]: r["n"] for r in rows.groupBy("list").agg(F.sum(F.size(F.filter("passing", lambda x: x))).alias("n")).collect()}  # a number for each list
    passes = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for i in range(passes):
        part = _block(index, rows, asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i), per_list, k, probes)
        found = part if found is None else found.unionByName(part)
    return top(found, k, [F.desc("score"), F.asc("doc_id")], ["query_id"])


def _block(index: VectorIndex, rows: DataFrame, asked: DataFrame, per_list: dict[int, int], k: int, probes: int) -> DataFrame:
    dim = index.centroids.shape[1]
    own = asked.toPandas()
    q = unit(np.array(own["vector"].tolist(), np.float32).reshape(-1, dim))
    order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
    have = np.array([per_list.get(i, 0) for i in range(len(index.centroids))])
    before = np.cumsum(have[order], axis=1) - have[order]
    wanted = ((np.cumsum(have[order] > 0, axis=1) <= probes) | (before < ENOUGH * k)) & (have[order] > 0)
    asks: dict[int, list[int]] = {}
    for i, j in zip(*np.nonzero(wanted), strict=True):
        asks.setdefault(int(order[i, j]), []).append(int(i))
    held = asked.sparkSession.sparkContext.broadcast((own["query_id"].to_numpy(np.int64), q, {x: np.array(who) for x, who in asks.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, asks = held.value
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            for r in range(batch.num_rows):
                who = asks.get(batch.column("list")[r].as_py())
                if who is None:
                    continue
                values = lambda name: batch.column(name)[r].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                v = values("vectors").reshape(-1, dim)
                links, passing = values("links").reshape(len(v), -1), values("passing")
                met = [(i, *walk(v, links, passing, q[who[i : i + QUERIES]], k)[:2]) for i in range(0, len(who), QUERIES)]
                row, node = np.concatenate([i + r for i, r, _ in met]), np.concatenate([x for *_, x in met])
                doc, who = values("ids")[node], who[row]
                exact = np.einsum("nd,nd->n", v[node].astype(np.float64), q[who].astype(np.float64))
                query, doc, sim = np.append(best[0], who), np.append(best[1], doc), np.append(best[2], exact)
                order = np.lexsort((doc, -sim, query))
                query = query[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                kept = place < k
                best = (query[kept], doc[order][kept], sim[order][kept])
        yield pa.record_batch({"query_id": pa.array(names[best[0]]), "doc_id": pa.array(best[1]), "score": pa.array(best[2])})

    some = rows.where(F.col("list").isin(*asks)) if asks else rows.limit(0)
    return some.select("list", "ids", "vectors", "links", "passing").mapInArrow(run, "query_id long, doc_id long, score double")
