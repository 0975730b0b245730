"""Filters on search terms and on lexical scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylane.functions import text
from quarrylane.plans.retrieval import lexical_index, lexical_scores
from quarrylane.queries.aggregates import BM25
from quarrylane.queries.joins import ASCII, duck_tokens
from quarrylane.registry import query
from quarrylane.sources.entities import table


@query("f16_bm25_positive", f"WITH {BM25} SELECT query_id, count(*) AS hits, round(min(score), 6) AS least FROM b GROUP BY query_id")
def f16(spark, sf):
    queries = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    scores = lexical_scores(lexical_index(table(spark, sf, "documents")), queries)
    return scores.groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.min("score"), 6).alias("least"))


@query("f17_stop_tokens", f"SELECT doc_id, len(regexp_extract_all({ASCII.format('text')}, '{text.TOKEN}')) AS found, len({duck_tokens('text')}) AS kept FROM documents")
def f17(spark, sf):
    found = F.regexp_extract_all(F.lower("text"), F.lit(text.TOKEN), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("found"), F.size(text.tokens(F.col("text"))).cast("long").alias("kept"))
