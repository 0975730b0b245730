"""The lexical index and its searches: blocks of documents with their postings by term, pruned top-k.

The index is partitioned by documents: a block is some hundred documents, with a row for each of their terms. It is made
where the texts are read, without a shuffle. A search brings the asked terms' rows of a block together, and works on it
whole: a block whose greatest contributions can't lift any document among a query's best so far isn't scored for it. Only
each task's k best go on, never all pairs of queries and documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylane.functions import numeric, text
from quarrylane.session import CARRIED, spread, table

#: The documents of a block.
BLOCK = 256
#: By how much a bound may be off by rounding.
SLACK = 1e-6
#: BM25's constants.
K1, B = 1.5, 0.75


def top(df: DataFrame, k: int, by: list[Column], partition: list[str], rank: str = "rank") -> DataFrame:
    """The first k rows of each partition with their rank. `by` has to order fully; Spark cuts groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*by)).cast("long")).where(F.col(rank) <= k)


@dataclass
class LexicalIndex:
    """An inverted index: blocks as blocks_of() makes them, terms (term, df, idf), stats (one row: n, avgdl)."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """Rows (doc_id, term, tf, dl)."""
        return _flat(self.blocks.where("term is not null"))


def _flat(blocks: DataFrame) -> DataFrame:
    return blocks.select("term", F.explode(F.arrays_zip("ids", "tf", "dl")).alias("p")).select(F.col("p.ids").alias("doc_id"), "term", F.col("p.tf").alias("tf"), F.col("p.dl").alias("dl"))


def _blocked(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (doc_id, tokens): a row for each term, and one without a term that has all of a block's documents."""
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            tokens, ids = part.column("tokens"), part.column("doc_id")
            n = part.num_rows
            dl = tokens.value_lengths().to_numpy().astype(np.int64)
            coded = tokens.flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            key, tf = np.unique(codes * n + np.repeat(np.arange(n), dl), return_counts=True)
            term, doc = np.append(key // n, np.full(n, len(coded.dictionary))), np.append(key % n, np.arange(n))
            tf = np.append(tf, np.ones(n, np.int64))
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            ends = pa.array(np.append(first, len(term)).astype(np.int32))
            listed = lambda values: pa.ListArray.from_arrays(ends, values)  # noqa: E731, B023
            yield pa.record_batch({
                "block": pa.array([hash_of(ids)] * len(first), pa.int64()), "term": pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]).take(pa.array(term[first])),
                "most_tf": pa.array(np.maximum.reduceat(tf, first)), "least_dl": pa.array(np.minimum.reduceat(dl[doc], first)),
                "ids": listed(ids.take(pa.array(doc))), "tf": listed(pa.array(tf)), "dl": listed(pa.array(dl[doc])),
            })


def hash_of(ids: pa.Array) -> int:
    """A block's number, by its documents: the same whenever it is made again."""
    import xxhash

    return xxhash.xxh64_intdigest(repr(ids.to_pylist()).encode()) >> 1


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows (block, term, most_tf, least_dl, ids, tf, dl): a block's documents with a term, how often, and their lengths.

    Each block has a row without a term, of all its documents. Texts are cut into terms once, and counted where they are:
    nothing is shuffled unless identifiers repeat. Rows of one identifier are one document.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tokens = spread(rows).select("doc_id", F.coalesce(text.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        tokens = tokens.groupBy("doc_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(lambda batches: _blocked(batches, block), f"block long, term string, most_tf long, least_dl long, ids array<{kind}>, tf array<long>, dl array<long>")


def postings_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, term, tf, dl), and for each document one without a term."""
    return _flat(blocks_of(docs, id_col, text_col))


def lexical_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epsilon: float = 0.25, path: str | None = None) -> LexicalIndex:
    """Blocks and BM25 statistics. Negative idf becomes epsilon times the mean idf over all terms, negative ones too.

    Blocks are written once (to `path`, or to the shared folder), in one scan; all statistics come from them. An index
    written before is opened by open_index().
    """
    return index_of(table(blocks_of(docs, id_col, text_col), path), epsilon)


def open_index(spark: SparkSession, path: str, epsilon: float = 0.25) -> LexicalIndex:
    """An index whose blocks were written to `path`."""
    return index_of(spark.read.parquet(path), epsilon)


def extend_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", epsilon: float = 0.25) -> LexicalIndex:
    """Add documents to the index at `path`: only new texts are cut into terms.

    Documents that the index has are left as they are, so that a repeated call, after a failure say, adds none twice.
    """
    known = docs.sparkSession.read.parquet(path).where("term is null").select(F.explode("ids").alias(id_col))
    new = table(docs.select(id_col, text_col).join(known, id_col, "left_anti"))
    blocks_of(new, id_col, text_col).write.mode("append").parquet(path)
    return open_index(docs.sparkSession, path, epsilon)


def index_of(blocks: DataFrame, epsilon: float = 0.25) -> LexicalIndex:
    """An index over blocks as blocks_of() makes them."""
    total = F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x)
    stats = blocks.where("term is null").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.sum(total).alias("total"))
    stats = table(stats.select("n", (F.coalesce("total", F.lit(0)) / F.when(F.col("n") > 0, F.col("n"))).alias("avgdl")))
    df = blocks.where("term is not null").groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
    raw = table(df.crossJoin(F.broadcast(stats)).select("term", "df", "avgdl", "n", numeric.bm25_idf(F.col("df"), F.col("n")).alias("raw")))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(blocks, terms, stats)


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """Rows (query_id, term, qtf)."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode_outer(text.tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def lexical_scores(index: LexicalIndex, queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """All positive BM25 scores (query_id, doc_id, score); a term that a query repeats counts again."""
    weight = numeric.bm25_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    hits = query_terms(queries, id_col, text_col).join(index.terms, "term").join(index.postings, "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(weight * F.col("qtf")).alias("score")).where("score > 0")


class Scorer:
    """The k best documents of each query over the blocks that it is given.

    `heads` and `asked` are the queries' terms: term t is asked by queries asked[heads[t]:heads[t + 1]] with those weights.
    """

    def __init__(self, queries: int, heads: np.ndarray, asked: np.ndarray, weights: np.ndarray, mean_length: float, k: int):
        self.heads, self.asked, self.weights, self.mean, self.k = heads, asked, weights, mean_length, k
        self.bound = np.zeros(queries)  # the k-th best score so far
        self.query, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0), None
        self.scored = 0  # pairs of a query and a document

    def impact(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.mean))

    def add(self, terms: np.ndarray, most: np.ndarray, least: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> None:
        """A block: its rows' terms, greatest frequencies, least lengths and numbers of postings, and the postings."""
        many = self.heads[terms + 1] - self.heads[terms]
        at = np.repeat(self.heads[terms] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        row, query, weight = np.repeat(np.arange(len(terms)), many), self.asked[at], self.weights[at]
        reach = np.bincount(query, weight.clip(0) * self.impact(most, least)[row], len(self.bound))
        open_ = (reach > 0) & (reach >= self.bound - SLACK)
        own = open_[query]
        row, query, weight = row[own], query[own], weight[own]
        if not len(row):
            return
        docs, place = np.unique(ids, return_inverse=True)
        live = np.flatnonzero(open_)
        local = np.zeros(len(self.bound), np.int64)
        local[live] = np.arange(len(live))
        begin, impact = np.cumsum(sizes) - sizes, self.impact(tf, dl)
        many = sizes[row]
        p = np.repeat(begin[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        cell = np.repeat(local[query] * len(docs), many) + place[p]
        score = np.bincount(cell, np.repeat(weight, many) * impact[p], len(live) * len(docs)).round(9)
        self.scored += len(live) * len(docs)
        hit = np.flatnonzero((score > 0) & (score >= np.repeat(self.bound[live], len(docs)) - SLACK))
        query, score, doc = np.append(self.query, live[hit // len(docs)]), np.append(self.score, score[hit]), docs[hit % len(docs)]
        doc = doc if self.doc is None else np.append(self.doc, doc)
        order = np.lexsort((doc, -score, query))
        query = query[order]
        start = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        kept = rank < self.k
        self.query, self.score, self.doc = query[kept], score[order][kept], doc[order][kept]
        last = np.flatnonzero(rank == self.k - 1)
        self.bound[query[last]] = score[order][last]


def _search(held, k: int):
    """Rows (code, block, ...) sorted by block, to each task's k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, heads, asked, weights, mean = held.value
        scorer, rest = Scorer(len(names), heads, asked, weights, mean, k), None

        def add(rows: pa.RecordBatch | pa.Table) -> None:
            column = lambda name: rows.column(name).to_numpy()
            flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            scorer.add(column("code"), column("most_tf"), column("least_dl"), column("size"), flat("ids"), flat("tf"), flat("dl"))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            block = rows.column("block").to_numpy()
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
            for a, b in zip(first[:-1], first[1:], strict=True):
                add(rows.slice(a, b - a))
            rest = rows.slice(first[-1])
        if rest is not None:
            add(rest)
        if len(scorer.query):
            yield pa.record_batch({"query_id": names.take(pa.array(scorer.query)), "doc_id": pa.array(scorer.doc.tolist()), "score": pa.array(scorer.score)})

    return run


def lexical_search(index: LexicalIndex, queries: DataFrame, k: int = 20, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each query by BM25: (query_id, doc_id, score, rank); ties go to the smaller doc_id.

    Exact: a block is left out for a query only if it can't have any of its k best. The queries go out by broadcast, at most
    about CARRIED terms at a time; more are further passes over the index. Documents without an identifier aren't found.
    """
    asked = table(query_terms(queries, id_col, text_col).where("query_id is not null").join(index.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("idf") * F.col("qtf")).alias("weight")))
    passes = max(1, -(-asked.count() // CARRIED))
    found = [_pass(index, asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i), k) for i in range(passes)]
    return top(reduce(DataFrame.unionByName, found), k, [F.desc("score"), F.asc("doc_id")], ["query_id"])


def _pass(index: LexicalIndex, asked: DataFrame, k: int) -> DataFrame:
    rows = asked.toArrow()
    spark, names = asked.sparkSession, rows.column("query_id").unique()
    terms = rows.column("term").combine_chunks().dictionary_encode()
    code = terms.indices.to_numpy(zero_copy_only=False)
    query = rows.column("query_id").combine_chunks().dictionary_encode()
    order = np.argsort(code, kind="stable")
    heads = np.append(0, np.cumsum(np.bincount(code, minlength=len(terms.dictionary))))
    mean = index.stats.first().avgdl or 1.0
    held = spark.sparkContext.broadcast((query.dictionary, heads, query.indices.to_numpy(zero_copy_only=False)[order], rows.column("weight").to_numpy()[order], mean))
    known = spark.createDataFrame(pa.table({"term": terms.dictionary, "code": pa.array(np.arange(len(terms.dictionary)))}), "term string, code long") if len(names) else asked.select("term", F.lit(0).cast("long").alias("code"))
    hits = index.blocks.join(F.broadcast(known), "term").select("block", "code", "most_tf", "least_dl", F.size("ids").cast("long").alias("size"), "ids", "tf", "dl")
    kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    near = hits.repartition(F.col("block")).sortWithinPartitions("block")
    return near.mapInArrow(_search(held, k), f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {kind}, score double")
