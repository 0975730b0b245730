"""The retrieval funnel: lexical and vector search, fusion, re-ranking, evaluation. Each step is a plan over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import numeric, text
from quarrylane.plans.lexical import LexicalIndex, extend_index, index_of, lexical_index, lexical_scores, lexical_search, open_index, postings_of, top  # noqa: F401 (offered here too)
from quarrylane.session import carried, spread, table

#: Queries that a vector search broadcasts at once.
QUERY_BLOCK = 4096
#: Vectors and queries of a tile that a task multiplies at once.
ROWS, QUERIES = 1024, 256
#: Stretches of ids whose rows may share a tile of tiled_pairs(), queries in a cycle (as many as Parquet packs in one run), pairs made at
#: once, and how many tiles of queries are broadcast.
DOC_STRETCH, QUERY_STRETCH, CYCLE, PAIRS, CARRIED_TILES = 1 << 11, 1 << 20, 504, 1 << 16, 1 << 9


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The k nearest vectors (doc_id, embedding) of each query (query_id, vector) by cosine: (query_id, doc_id, score, rank).

    Exact, in double precision; vectors of zero length score zero, null ones and those of another length are left out.
    Each task multiplies its batches with a block of at most QUERY_BLOCK queries and passes on only its own k best of
    each, so that a shuffle sees partitions x queries x k rows, not all pairs. More queries make more blocks, each a
    pass over the vectors; what is broadcast keeps its bound.
    """
    return top(_in_blocks(vectors, queries, k), k, [F.desc("score"), F.asc("doc_id")], ["query_id"])


def tiled_pairs(docs: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs (query_id, doc_id) of the rows of docs (doc_id, keys) and queries (query_id, keys) whose keys are equal.

    Ids are whole numbers, not null. The pairs' number may grow with the square of the rows; a task holds a tile of each side
    and PAIRS pairs. Rows of equal keys and of one stretch of ids are a tile. A tile's pairs stand together, so that a file
    has runs of one document and short cycles of queries, which Parquet keeps in a fraction of a byte a pair; in the order of
    a join they take five bytes. Tiles of documents are dealt out by ranges of keys, so that a file has few different queries.
    """
    parts = 4 * docs.sparkSession.sparkContext.defaultParallelism

    def tiles(rows: DataFrame, x: str, stretch: int) -> DataFrame:
        return table(rows.groupBy(*keys, F.floor(F.col(x) / stretch).alias("stretch")).agg(F.collect_list(F.col(x).cast("long")).alias(f"{x}s")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, d in zip(batch["query_ids"], batch["doc_ids"], strict=True):
                q, d = q.values.to_numpy(), d.values.to_numpy()
                for qs in np.split(q, sorted({*range(CYCLE, len(q), CYCLE), len(q) // 8 * 8} - {0, len(q)})):  # Parquet packs eight values to whole bytes
                    step = max(1, PAIRS // len(qs))
                    for ds in (d[i : i + step] for i in range(0, len(d), step)):
                        yield pa.record_batch([pa.array(np.tile(qs, len(ds))), pa.array(np.repeat(ds, len(qs)))], ["query_id", "doc_id"])

    dealt = tiles(docs, "doc_id", DOC_STRETCH).repartitionByRange(parts, *keys, "stretch").drop("stretch")
    met = dealt.join(carried(tiles(queries, "query_id", QUERY_STRETCH).drop("stretch"), CARRIED_TILES), keys)
    return met.select("query_ids", "doc_ids").mapInArrow(run, "query_id long, doc_id long")


def dense_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The cosine of each query with each vector (query_id, doc_id, score), where that is what is asked for."""
    return _in_blocks(vectors, queries, None)


def _in_blocks(vectors: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    return reduce(DataFrame.unionByName, [_scores_of_block(vectors, queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k) for i in range(blocks)])


def _cosines(part: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
    v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
    norm = np.linalg.norm(v, axis=1)
    return q @ v.T / np.where(norm == 0, 1, norm)


def nearest_of(batches: Iterator[pa.RecordBatch], q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k best (identifiers, cosines) of all batches (doc_id, v) for each of the queries, whose rows have unit length.

    At once ROWS vectors meet QUERIES queries: beside the best, memory is that of one such tile, whatever the queries' number.
    """
    best_id, best = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            doc = part.column("doc_id").to_numpy()
            wide = min(k, best.shape[1] + len(doc))
            new_id, new = np.empty((len(q), wide), np.int64), np.empty((len(q), wide))
            for i in range(0, len(q), QUERIES):
                own = slice(i, i + QUERIES)
                score = _cosines(part, q[own])
                some = np.concatenate([best[own], score.round(9)], axis=1)
                some_id = np.concatenate([best_id[own], np.broadcast_to(doc, score.shape)], axis=1)
                order = np.lexsort((some_id, -some), axis=1)[:, :k]
                new[own], new_id[own] = np.take_along_axis(some, order, 1), np.take_along_axis(some_id, order, 1)
            best, best_id = new, new_id
    yield best_id, best


def _scores_of_block(vectors: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    """Each task's k best vectors for each of the queries, or all."""
    rows = queries.where("vector is not null").select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).toPandas()
    dim = max(map(len, rows["vector"]), default=0)
    rows = rows[rows["vector"].map(len) == dim]
    ids = rows["query_id"].to_numpy(np.int64)
    q = np.stack(rows["vector"].to_numpy()) if len(rows) else np.zeros((0, dim))
    size = np.linalg.norm(q, axis=1, keepdims=True)
    held = vectors.sparkSession.sparkContext.broadcast((ids, q / np.where(size == 0, 1, size)))

    def out(ids: np.ndarray, best_id: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"query_id": pa.array(np.repeat(ids, best.shape[1])), "doc_id": pa.array(best_id.reshape(-1)), "score": pa.array(best.reshape(-1))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        if k is not None:
            yield from (out(ids, *found) for found in nearest_of(batches, q, k) if found[1].size)
            return
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                score = _cosines(part, q)
                yield out(ids, np.broadcast_to(part.column("doc_id").to_numpy(), score.shape), score)

    sound = vectors.where(F.size("embedding") == dim) if len(ids) else vectors.limit(0)
    return sound.select(F.col("doc_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, "query_id long, doc_id long, score double")


def fuse(channels: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of channels (query_id, doc_id, rank): rrf and each channel's rank, null where it has none.

    One shuffle whatever the number of channels.
    """
    rows = reduce(DataFrame.unionByName, [c.select("query_id", "doc_id", F.lit(name).alias("channel"), "rank") for name, c in channels.items()])
    ranks = [F.max(F.when(F.col("channel") == name, F.col("rank"))).alias(f"{name}_rank") for name in channels]
    return rows.groupBy("query_id", "doc_id").agg(F.sum(numeric.rrf_term(F.col("rank"), k)).alias("rrf"), *ranks)


def hybrid_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, top_k: int = 10, channel_k: int = 50) -> DataFrame:
    """Both channels, fused: (query_id, doc_id, rrf, dense_rank, bm25_rank, rank)."""
    dense = dense_search(vectors, query_vectors, channel_k)
    lexical = lexical_search(lexical_index(docs), queries, channel_k)
    fused = fuse({"dense": dense, "bm25": lexical}).withColumn("rrf", F.round("rrf", 9))
    return top(fused, top_k, [F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.asc("doc_id")], ["query_id"])


def format_candidate(row_text: Column, headline: Column, years: Column, skills: Column, summary: Column) -> Column:
    """What a scorer reads: the text, or a line made of the other fields where there is none."""
    made = F.concat(
        F.lit("Role: "), F.coalesce(headline, F.lit("Software Professional")), F.lit(" | Experience: "), F.coalesce(years.cast("string"), F.lit("0")),
        F.lit(" years | Core Competencies: "), F.array_join(F.slice(F.coalesce(skills, F.array().cast("array<string>")), 1, 15), ", "), F.lit(" | Summary: "), F.coalesce(summary, F.lit("")),
    )
    return F.coalesce(F.nullif(row_text, F.lit("")), made)


def overlap_logit(query: Column, passage: Column) -> Column:
    """The offline stand-in for a cross-encoder: the share of the query's terms that the passage has, as a logit of -4 to 4."""
    return overlap_of_terms(distinct_terms(query), distinct_terms(passage))


def distinct_terms(value: Column) -> Column:
    """A text's search terms, each once."""
    return F.array_distinct(text.tokens(value))


def overlap_of_terms(terms: Column, passage: Column) -> Column:
    """overlap_logit() of distinct terms, for texts that meet more than one other: they are cut into terms before."""
    shared = F.size(F.array_intersect(terms, passage))
    return F.when(F.size(terms) == 0, F.lit(-4.0)).otherwise(shared / F.size(terms) * 8.0 - 4.0)


def model_scores(pairs: DataFrame, load, batch: int = 32) -> DataFrame:
    """Pairs (query, passage, ...) with `raw_score` by a model that load() gives once a worker: a list of pairs to numbers."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, passages in parts:
            rows = list(zip(queries, passages, strict=True))
            yield pd.Series([float(x) for k in range(0, len(rows), batch) for x in model(rows[k : k + batch])], dtype="float64")

    return pairs.withColumn("raw_score", score("query", "passage"))


def rerank(pairs: DataFrame, top_k: int = 20, scored: bool = False) -> DataFrame:
    """Re-rank (query_id, doc_id, rank, query, passage): adds raw_score, rerank_score (4 decimals), rerank_rank."""
    if not scored:
        pairs = pairs.withColumn("raw_score", overlap_logit(F.col("query"), F.col("passage")))
    scores = pairs.withColumn("rerank_score", F.round(numeric.sigmoid(F.col("raw_score")), 4))
    return top(scores, top_k, [F.desc("rerank_score"), F.asc("rank")], ["query_id"], "rerank_rank")


def evaluate(rows: DataFrame, passage: str = "passage") -> DataFrame:
    """The rule-based evaluation of each row: match_score and tier."""
    score = numeric.rule_score(F.col(passage))
    return rows.withColumn("match_score", score).withColumn("tier", F.when(score >= 80, "Strong Fit").otherwise("Low Match"))


def funnel(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, retrieve_k: int = 100, final_k: int = 20) -> DataFrame:
    """Retrieve, attach texts, re-rank, evaluate, sort: one row for each query's result.

    Narrow first: only retrieved documents are cut into terms, each once, however many queries they answer.
    """
    found = table(hybrid_search(docs, vectors, queries, query_vectors, retrieve_k))
    asked = queries.select("query_id", distinct_terms(F.col("text")).alias("terms"))
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("passage")).join(carried(found.select("doc_id").distinct()), "doc_id", "left_semi")
    passages = evaluate(spread(some)).select("doc_id", "match_score", "tier", distinct_terms(F.col("passage")).alias("passage_terms"))
    none = evaluate(queries.sparkSession.createDataFrame([("",)], "passage string")).first()  # for retrieved documents without a text
    pairs = found.join(carried(asked), "query_id").join(passages, "doc_id", "left").fillna({"match_score": none.match_score, "tier": none.tier})
    logit = overlap_of_terms(F.col("terms"), F.coalesce("passage_terms", F.array().cast("array<string>")))
    ranked = rerank(pairs.withColumn("raw_score", logit).drop("terms", "passage_terms"), final_k, scored=True)
    final = Window.partitionBy("query_id").orderBy(F.desc("match_score"), F.asc("rerank_rank"))
    return ranked.withColumn("position", F.row_number().over(final).cast("long"))


@dataclass
class VectorFilters:
    """Optional filters of a vector search; None or empty means none."""

    min_years: float | None = None
    max_years: float | None = None
    location: str | None = None
    education: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    limit: int = 10

    def predicates(self) -> list[Column]:
        out = []
        if self.min_years is not None:
            out.append(F.col("years_of_experience") >= self.min_years)
        if self.max_years is not None:
            out.append(F.col("years_of_experience") <= self.max_years)
        if self.location:
            out.append(F.col("location").ilike(f"%{self.location.strip()}%") | F.col("location").ilike("%Remote%"))
        if self.education:
            out.append(reduce(lambda a, b: a | b, [F.col("highest_education").ilike(f"%{e.strip()}%") for e in self.education]))
        if self.skills:
            out.append(reduce(lambda a, b: a & b, [F.array_contains("skills", s) for s in self.skills]))
        return out


def vector_search(candidates: DataFrame, query_vectors: DataFrame, filters: VectorFilters) -> DataFrame:
    """Nearest candidates with a vector that pass the filters; filters come before the distances."""
    if not 1 <= filters.limit <= 100:
        raise ValueError("limit is 1 to 100")
    rows = candidates.where(F.col("embedding").isNotNull())
    for predicate in filters.predicates():
        rows = rows.where(predicate)
    near = dense_search(rows.select(F.col("id").alias("doc_id"), "embedding"), query_vectors, filters.limit)
    return near.join(rows.drop("embedding"), near.doc_id == rows.id).withColumn("similarity_score", F.round("score", 4))
