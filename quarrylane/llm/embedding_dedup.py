"""Operator 5, near-duplicate embeddings, by product quantisation over inverted lists.

Equal vectors become one representative first. Representatives go to the inverted list of their nearest coarse
centroid, their residuals are coded by subspace. Of two linked vectors in different lists the offset crosses the border
between their centroids, so that one of them lies no farther from it than half the offset's length across it: each
vector probes, besides its own list, those whose border is as near as that. In a list, table-lookup distances to the
codes leave out whatever cannot be near, by the triangle inequality with each code's known error; the rest is ranked by
its exact cosine. Centroids and codes are fitted on a bounded sample; every row is indexed. Long lists are met block by
block. Vectors of one length are an index of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.common import components, table

#: Vectors that the index is fitted on, about; lists up to which centroids are refined (more are vectors of the sample); the
#: most bytes of centroids; rows of a block; dimensions of a subspace and its codes.
SAMPLE, REFINED, CENTROID_BYTES, BLOCK, SUB, CODES = 20_000, 4096, 1 << 26, 2048, 4, 256
#: How long an offset across a border may be to be followed, in standard deviations of a linked vector's: an offset of
#: length r in d dimensions has r / sqrt(d) across a given border. Of links at the very limit of the cosine, in directions
#: that are no rule, three in a hundred thousand are longer. None follows every offset: no link is missed.
REACH = 4.0


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 11) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty cell keeps its centroid."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centres.T - half, axis=1) for k in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    centres: np.ndarray  # (lists, d)
    books: np.ndarray  # (d / SUB, CODES, SUB)
    least: float  # the cosine of a link
    reach: float | None

    @property
    def radius(self) -> float:
        return float(np.sqrt(2 - 2 * self.least)) + 1e-6

    def _parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into subspaces, the last one filled up with zeros: (subspaces, rows, SUB)."""
        pad = -x.shape[1] % SUB
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB).transpose(1, 0, 2)

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, subspaces) and the length of what they miss."""
        parts = self._parts(residuals)
        codes = np.stack([_nearest(p, b) for p, b in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)
        missed = sum(((p - b[c]) ** 2).sum(1) for p, b, c in zip(parts, self.books, codes.T, strict=True))
        return codes, np.sqrt(missed)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each unit vector's list; and the others that vectors probe, as pairs (vector, list) in order."""
        half = self.radius / 2
        if self.reach is not None:
            half *= min(1.0, self.reach / np.sqrt(x.shape[1]))
        power = (self.centres**2).sum(1)
        homes, rows, lists = [], [], []
        step = max(1, (1 << 22) // len(self.centres))
        for k in range(0, len(x), step):
            d2 = np.maximum((x[k : k + step] ** 2).sum(1)[:, None] + power - 2 * x[k : k + step] @ self.centres.T, 0)
            home = np.argmin(d2, axis=1)
            least = d2[np.arange(len(home)), home]
            # A border nearer than half needs a centroid farther by no more than twice that.
            i, j = np.nonzero(d2 <= (np.sqrt(least) + 2 * half + 1e-6)[:, None] ** 2)
            apart = np.sqrt(((self.centres[j] - self.centres[home[i]]) ** 2).sum(1))
            keep = (d2[i, j] - least[i] <= 2 * apart * half + 1e-6) & (j != home[i])
            homes.append(home)
            rows.append(i[keep] + k)
            lists.append(j[keep])
        return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (homes, rows, lists))

    def near(self, queries: np.ndarray, codes: np.ndarray, missed: np.ndarray, of: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member) of a list whose asymmetric distance leaves a link possible.

        The distance to a code is its own length, the query's, and dot products looked up in a table for each subspace.
        """
        residuals = queries - self.centres[of]
        parts, own = self._parts(residuals), (residuals**2).sum(1)
        tables = [(b[u], at) for b, (u, at) in zip(self.books, (np.unique(c, return_inverse=True) for c in codes.T), strict=True)]
        limit = (self.radius + missed + 1e-4) ** 2 - sum((b**2).sum(1)[at] for b, at in tables)
        found = []
        for k in range(0, len(queries), 256):
            total = np.zeros((len(own[k : k + 256]), len(codes)), np.float32)
            for p, (b, at) in zip(parts, tables, strict=True):
                total += (p[k : k + 256] @ b.T)[:, at]
            i, j = np.nonzero(own[k : k + 256, None] - 2 * total <= limit)
            found.append((i + k, j))
        return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def fit(reps: DataFrame, n: int, dim: int, kind: str, least: float, reach: float | None) -> Index | None:
    """Fit lists and codes on a sample of representatives (node, vec), those whose hashed node is lowest.

    Lists grow with the root of n, up to CENTROID_BYTES of centroids; the sample has about SAMPLE vectors, or one for
    each list where there are more lists.
    """
    lists = min(CENTROID_BYTES // (4 * dim), 1 << max(0, int(np.ceil(np.log2(4 * np.sqrt(n))))))
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    rows = reps.where(draw < min(1.0, max(SAMPLE, 1.1 * lists) / max(n, 1))).select("node", "vec").toPandas().sort_values("node")
    if not len(rows):
        return None
    x = _unit(np.frombuffer(b"".join(rows["vec"]), kind).reshape(-1, dim))
    centres = _kmeans(x, lists, 8 if lists <= REFINED else 0)
    index = Index(centres, np.zeros((0, CODES, SUB), np.float32), least, reach)
    x = x[:SAMPLE]
    parts = index._parts(x - centres[_nearest(x, centres)])
    index.books = np.stack([np.resize(_kmeans(np.ascontiguousarray(p), CODES, 6), (CODES, SUB)) for p in parts])
    return index


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision over their largest component, so that no square over- or underflows."""
    x = x.astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def _meet(held, dim: int, kind: str):
    """Links of one block of queries with one block of members: for each node the number of vectors that it links, and
    links that connect what is linked here."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        index, of = held.value, int(key[0])
        members, queries = group[group["member"]], group[~group["member"]]
        none = pd.DataFrame({"node": np.zeros(0, np.int64), "to": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        if not len(members) or not len(queries):
            return none
        raw = [np.frombuffer(b"".join(x["vec"]), kind).reshape(-1, dim) for x in (queries, members)]
        codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(members), -1)
        i, j = index.near(_unit(raw[0]), codes, members["missed"].to_numpy(), of)
        a, b, home = queries["node"].to_numpy(), members["node"].to_numpy(), queries["home"].to_numpy()
        # Within a list each pair comes up both ways; so does one of two lists if each vector probes the other's.
        other = [np.frombuffer(p, "<i4").astype(np.int64) for p in members["probes"]]
        probed = np.concatenate([p * len(members) + k for k, p in enumerate(other)])
        keep = np.where(home[i] == of, a[i] < b[j], (home[i] < of) | ~np.isin(home[i].astype(np.int64) * len(members) + j, probed))
        i, j = i[keep], j[keep]
        exact = []
        for k in range(0, len(i), 50_000):
            x, y = _scaled(raw[0][i[k : k + 50_000]]), _scaled(raw[1][j[k : k + 50_000]])
            exact.append((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= index.least)
        yes = np.concatenate(exact) if exact else np.zeros(0, bool)
        i, j = i[yes], j[yes]
        if not len(i):
            return none
        nodes, where = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
        u, v = where[: len(i)], where[len(i) :]
        n = np.bincount(u, members["mult"].to_numpy()[j], len(nodes)) + np.bincount(v, queries["mult"].to_numpy()[i], len(nodes))
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"node": nodes, "to": nodes[root], "n": n.astype(np.int64)})

    return run


def _links(reps: DataFrame, dim: int, kind: str, least: float, reach: float | None) -> DataFrame | None:
    """Rows (node, to, n) of the links among representatives (node, mult, vec) of one length; None if there are none."""
    spark, n = reps.sparkSession, reps.count()
    index = fit(reps, n, dim, kind, least, reach) if n > 1 else None
    if index is None:
        return None
    held = spark.sparkContext.broadcast(index)  # at most CENTROID_BYTES of centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = held.value
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                b = whole.slice(k, 2048)
                x = _unit(np.frombuffer(b"".join(b.column("vec").to_pylist()), kind).reshape(-1, dim))
                home, row, of = own.assign(x)
                codes, missed = own.encode(x - own.centres[home])
                edges = np.searchsorted(row, np.arange(len(x) + 1))
                probes = [of[p:q].astype("<i4").tobytes() for p, q in zip(edges, edges[1:], strict=False)]
                at = np.concatenate([np.arange(len(x)), row])
                take, extra = pa.array(at), len(row)
                yield pa.record_batch({
                    "list": pa.array(np.concatenate([home, of]).astype(np.int32)), "home": pa.array(home[at].astype(np.int32)), "own": pa.array(np.arange(len(at)) < len(x)), "node": b.column("node").take(take),
                    "mult": b.column("mult").take(take), "vec": b.column("vec").take(take), "code": pa.array([*(c.tobytes() for c in codes), *[b""] * extra], pa.binary()),
                    "missed": pa.array(np.concatenate([missed, np.zeros(extra)]).astype(np.float64)), "probes": pa.array([*probes, *[b""] * extra], pa.binary()),
                })

    placed = table(reps.mapInArrow(place, "list int, home int, own boolean, node long, mult long, vec binary, code binary, missed double, probes binary"))
    sizes = placed.groupBy("list").agg(F.ceil(F.sum(F.col("own").cast("long")) / BLOCK).cast("int").alias("mb"), F.ceil(F.count("*") / BLOCK).cast("int").alias("qb"))
    h = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    blocks = placed.join(F.broadcast(sizes.where("mb > 0")), "list")  # a row for each list
    none = F.lit(b"").alias
    as_query = blocks.select("list", "home", F.lit(False).alias("member"), "node", "mult", "vec", none("code"), F.lit(0.0).alias("missed"), none("probes"), (h % F.col("qb")).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"))
    as_member = blocks.where("own").select("list", "home", F.lit(True).alias("member"), "node", "mult", "vec", "code", "missed", "probes", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), (h % F.col("mb")).cast("int").alias("m"))
    return as_query.unionByName(as_member).groupBy("list", "m", "q").applyInPandas(_meet(held, dim, kind), "node long, to long, n long")


def embedding_groups(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", reach: float | None = REACH) -> DataFrame:
    """Rows (vec_id, n_links, component_id), one for each row of vectors.

    Vectors of one length link at a cosine, in double precision, of `least` or more. Those that are null, empty, zero or
    hold null or non-finite numbers link with nothing: no links, their own component. Equal vectors link; copies count
    one by one in n_links, as do rows that repeat an identifier. A row with a null identifier counts for others and has
    the component of its vector (null if alone). An empty table gives no rows; other columns are ignored. `reach`: see
    REACH; with None the result is exact. Each length that occurs makes jobs of its own, one after the other.
    """
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind, element = ("<f8", "double") if element not in ("float", "tinyint", "smallint") else ("<f4", "float")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{element}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    key = F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ","), 256)
    marked = table(rows.withColumn("sound", sound).withColumn("key", F.when(sound, key)))
    groups = marked.where("sound").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("mult"), F.first("embedding").alias("embedding"))

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, edges = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind), b.column("embedding").value_lengths().to_numpy().cumsum()
            yield pa.record_batch({"key": b.column("key"), "node": b.column("node"), "mult": b.column("mult"), "d": b.column("d"), "vec": pa.array([x.tobytes() for x in np.split(flat, edges[:-1])] if b.num_rows else [], pa.binary())})

    # A group without any identifier gets a node of its own below all identifiers.
    named = groups.withColumn("node", F.coalesce("low", F.lit(-(1 << 62)) - F.abs(F.xxhash64("key") % (1 << 60))))
    reps = table(named.select("key", "node", "mult", F.size("embedding").alias("d"), "embedding").mapInArrow(to_bytes, "key string, node long, mult long, d int, vec binary"))
    lengths = sorted(r.d for r in reps.groupBy("d").count().where("count > 1").select("d").toLocalIterator())
    found = [x for d in lengths if (x := _links(reps.where(F.col("d") == d).select("node", "mult", "vec"), d, kind, least, reach)) is not None]
    met = table(reduce(DataFrame.unionByName, found)) if found else vectors.sparkSession.createDataFrame([], "node long, to long, n long")
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    linked = components(met.where("node <> to").select(F.col("node").alias("src"), F.col("to").alias("dst")))
    roots = reps.select("key", "node", "mult").join(counts, "node", "left").join(linked, "node", "left")
    roots = table(roots.select("key", "node", F.coalesce("component", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    # A component's name is its smallest identifier; nodes made up for groups without one give way.
    real = roots.groupBy("root").agg(F.min(F.when(F.col("node") > -(1 << 62), F.col("node"))).alias("component_id"))
    named = table(roots.join(real, "root").select("key", "n_links", "component_id"))
    together = marked.where("sound").join(named, "key").select("id", "n_links", "component_id")
    alone = marked.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return together.unionByName(alone).withColumnRenamed("id", id_col)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and its component at a cosine of 0.95 or more."""
    groups = embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return groups.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
