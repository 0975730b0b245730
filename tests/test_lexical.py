"""Pruned lexical search against scoring everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.plans import lexical
from quarrylane.session import shared_dir
from quarrylane.sources.entities import table


def corpus(rng, n, words=400):
    """Texts whose words are as uneven as in natural ones."""
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(n)]


def best(scores, k):
    rows = scores.withColumn("score", F.round("score", 9))
    return {(r.query_id, r.rank): (r.doc_id, r.score) for r in lexical.top(rows, k, [F.desc("score"), F.asc("doc_id")], ["query_id"]).collect()}


@pytest.mark.parametrize("seed,docs,k", [(1, 60, 5), (2, 900, 3), (3, 900, 20), (4, 5, 50)])
def test_pruned_search_equals_scoring_everything(spark, seed, docs, k):
    rng = random.Random(seed)
    texts = [*corpus(rng, docs), (docs, None), (docs + 1, ""), (docs + 2, "the of and")]
    texts += [(10_000 + i, t) for i, t in texts[:4]]  # equal texts have equal scores
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    queries = spark.createDataFrame([*corpus(rng, 12), (90, "w0 w1 w0"), (91, "w399"), (92, "nothing here"), (93, None)], "query_id long, text string")
    index = lexical.lexical_index(frame)
    want = best(lexical.lexical_scores(index, queries), k)
    got = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in lexical.lexical_search(index, queries, k).collect()}
    assert got == want and got


def test_terms_in_most_texts_have_no_negative_effect(spark):
    """With idf below zero for all terms, no score is positive; the search then finds nothing, as scoring does."""
    frame = spark.createDataFrame([(i, "aa bb cc") for i in range(5)], "doc_id long, text string")
    index = lexical.lexical_index(frame)
    queries = frame.withColumnRenamed("doc_id", "query_id")
    assert lexical.lexical_search(index, queries, 3).count() == lexical.lexical_scores(index, queries).count() == 0


def scored(index, queries, k):
    """How many pairs of a query and a document the search scores, in one task."""
    seen = []

    class Counting(lexical.Scorer):
        def add(self, *block):
            super().add(*block)
            seen.append(self.scored)

    asked = lexical.query_terms(queries).join(index.terms, "term").select("query_id", "term", (F.col("idf") * F.col("qtf")).alias("weight")).toPandas()
    names, terms = sorted(set(asked.query_id)), sorted(set(asked.term))
    asked["code"] = asked.term.map({t: i for i, t in enumerate(terms)})
    asked = asked.sort_values("code")
    heads = np.append(0, np.cumsum(np.bincount(asked.code, minlength=len(terms))))
    scorer = Counting(len(names), heads, asked.query_id.map({q: i for i, q in enumerate(names)}).to_numpy(), asked.weight.to_numpy(), index.stats.first().avgdl, k)
    for _, rows in index.blocks.toPandas().dropna(subset="term").groupby("block"):
        rows = rows[rows.term.isin(terms)]
        if len(rows):
            flat = lambda c: np.concatenate(rows[c].to_numpy())  # noqa: E731, B023
            scorer.add(rows.term.map({t: i for i, t in enumerate(terms)}).to_numpy(), rows.most_tf.to_numpy(), rows.least_dl.to_numpy(), rows.ids.map(len).to_numpy(), flat("ids"), flat("tf"), flat("dl"))
    return scorer.scored


def test_few_pairs_are_scored(spark):
    """Of queries with a word of few texts, most blocks are left out by their bounds."""
    rng = random.Random(8)
    texts = [(i, t + (f" topic{i // 40}" * 3)) for i, t in corpus(rng, 2000)]
    index = lexical.index_of(lexical.blocks_of(spark.createDataFrame(texts, "doc_id long, text string"), block=8))
    queries = spark.createDataFrame([(i, f"topic{i} w{i} w{i + 1} w0") for i in range(50)], "query_id long, text string")
    assert 50 * 5 <= scored(index, queries, 5) < 0.3 * 50 * 2000


def test_blocks_are_bounded_and_hold_all_postings(spark, sf):
    index = lexical.lexical_index(table(spark, sf, "documents"))
    blocks = index.blocks.collect()
    assert max(len(b.ids) for b in blocks) <= lexical.BLOCK
    assert sum(len(b.ids) for b in blocks if b.term) == index.postings.count() and sum(len(b.ids) for b in blocks if not b.term) == index.stats.first().n
    assert all(b.most_tf == max(b.tf) and b.least_dl == min(b.dl) for b in blocks)


def test_repeated_identifiers_are_one_document(spark):
    rows = [(1, "aa bb"), (1, "bb cc"), (2, None), (None, "aa"), (None, "dd")]
    got = {(r.doc_id, r.term): (r.tf, r.dl) for r in lexical.postings_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "aa"): (1, 4), (1, "bb"): (2, 4), (1, "cc"): (1, 4), (1, None): (1, 4), (2, None): (1, 0), (None, "aa"): (1, 2), (None, "dd"): (1, 2), (None, None): (1, 2)}


def test_extending_twice_adds_once(spark, sf):
    docs, path = table(spark, sf, "documents").select("doc_id", "text"), shared_dir(spark)
    lexical.lexical_index(docs.where("doc_id < 50"), path=path)
    once = lexical.extend_index(docs.where("doc_id >= 40"), path).stats.collect()
    assert lexical.extend_index(docs.where("doc_id >= 40"), path).stats.collect() == once == lexical.lexical_index(docs).stats.collect()
