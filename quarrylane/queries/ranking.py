"""Ranks over groups, top-k, ordering and paging. Every order has a tie-break, so that it is full."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylane.plans import quality
from quarrylane.plans.retrieval import VectorFilters, dense_search, fuse, lexical_index, lexical_search, rerank, top, vector_search
from quarrylane.queries.aggregates import BM25, FUNNEL, WEEKLY, hiring_funnel, weekly
from quarrylane.queries.joins import CHANNELS, duck_tokens, ranked
from quarrylane.registry import query
from quarrylane.sources.entities import entity, table

C, J, A, U = ("candidates",), ("jobs",), ("applications",), ("audits",)


@query("w01_channel_rank", "SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, id) AS rank FROM applications", A)
def w01(spark, sf):
    w = Window.partitionBy("job_id").orderBy(F.desc("score"), "id")
    return entity(spark, sf, "applications").select("job_id", "id", F.row_number().over(w).cast("long").alias("rank"))


@query("w02_rerank_rank", "SELECT job_id, id, round(score / 100, 1) AS s, row_number() OVER (PARTITION BY job_id ORDER BY round(score / 100, 1) DESC, stage_no, id) AS rank FROM applications", A)
def w02(spark, sf):
    w = Window.partitionBy("job_id").orderBy(F.desc("s"), "stage_no", "id")
    return entity(spark, sf, "applications").withColumn("s", F.round(F.col("score") / 100, 1)).select("job_id", "id", "s", F.row_number().over(w).cast("long").alias("rank"))


def metrics(spark, sf):
    apps = entity(spark, sf, "applications").select(F.col("job_id").alias("query_id"), F.col("id").alias("doc_id"), "score", "stage_no")
    results = top(apps, 20, [F.desc("score"), F.asc("doc_id")], ["query_id"])
    queries = entity(spark, sf, "jobs").select(F.col("id").alias("query_id"))
    return quality.retrieval_metrics(results, apps.where("stage_no >= 5"), queries)


METRICS = """r AS (SELECT job_id AS q, id, stage_no, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, id) AS rank FROM applications),
n AS (SELECT q, count(*) FILTER (WHERE stage_no >= 5) AS n, count(*) FILTER (WHERE stage_no >= 5 AND rank <= 5) AS h5, count(*) FILTER (WHERE stage_no >= 5 AND rank <= 10) AS h10,
count(*) FILTER (WHERE stage_no >= 5 AND rank <= 20) AS h20, min(rank) FILTER (WHERE stage_no >= 5 AND rank <= 20) AS first FROM r GROUP BY q),
j AS (SELECT id AS query_id, coalesce(n, 0) AS n, h5, h10, h20, first FROM jobs LEFT JOIN n ON q = id)"""


@query("w03_mrr", f"WITH {METRICS} SELECT query_id, round(CASE WHEN n = 0 THEN 1.0 ELSE coalesce(1.0 / first, 0) END, 6) AS mrr_20 FROM j", ("applications", "jobs"))
def w03(spark, sf):
    return metrics(spark, sf).select("query_id", F.round("mrr_20", 6).alias("mrr_20"))


@query("w04_recall_at_k", f"WITH {METRICS} SELECT query_id, round(CASE WHEN n = 0 THEN 1.0 ELSE h5 / least(5, n) END, 6) AS recall_5, round(CASE WHEN n = 0 THEN 1.0 ELSE h10 / least(10, n) END, 6) AS recall_10, round(CASE WHEN n = 0 THEN 1.0 ELSE h20 / least(20, n) END, 6) AS recall_20 FROM j", ("applications", "jobs"))
def w04(spark, sf):
    return metrics(spark, sf).select("query_id", *[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (5, 10, 20)])


@query("w05_is_peak", f"WITH {WEEKLY} SELECT concat('W', row_number() OVER (ORDER BY week)) AS week, n = max(n) OVER () AS is_peak FROM w")
def w05(spark, sf):
    return weekly(table(spark, sf, "events")).select("week", "is_peak")


@query("w06_step_conversion", f"WITH {FUNNEL} SELECT stage, round(n * 100.0 / lag(n) OVER (ORDER BY stage_no), 2) AS conversion FROM f", A)
def w06(spark, sf):
    return hiring_funnel(entity(spark, sf, "applications")).select("stage", "conversion")


@query("w07_employment_gaps", """WITH g AS (SELECT candidate_id, applied_at AS ended, lead(applied_at) OVER (PARTITION BY candidate_id ORDER BY applied_at, id) AS started FROM applications)
SELECT candidate_id, ended, started, CAST(date_diff('day', ended, started) AS BIGINT) AS days FROM g WHERE date_diff('day', ended, started) > 90""", A)
def w07(spark, sf):
    w = Window.partitionBy("candidate_id").orderBy("applied_at", "id")
    rows = entity(spark, sf, "applications").select("candidate_id", F.col("applied_at").alias("ended"), F.lead("applied_at").over(w).alias("started"))
    return rows.withColumn("days", F.datediff("started", "ended").cast("long")).where("days > 90")


@query("w08_kpi_delta", "WITH m AS (SELECT date_trunc('month', applied_at) AS month, count(*) AS n FROM applications GROUP BY 1) SELECT month, n, n - lag(n) OVER (ORDER BY month) AS change FROM m", A)
def w08(spark, sf):
    per = entity(spark, sf, "applications").groupBy(F.date_trunc("month", "applied_at").alias("month")).agg(F.count("*").alias("n"))
    return per.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("month")))  # one row a month


DENSE = """d AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
dr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d)"""


def vectors(spark, sf):
    """All vectors, and as queries those whose id is divisible by 50."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return rows, rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("s01_dense_topk", f"WITH {DENSE} SELECT query_id, doc_id, round(score, 6) + 0.0 AS score, rank FROM dr WHERE rank <= 50")
def s01(spark, sf):
    return dense_search(*vectors(spark, sf), 50).select("query_id", "doc_id", (F.round("score", 6) + 0.0).alias("score"), "rank")


@query("s02_bm25_topk", f"WITH {BM25}, br AS (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM br WHERE rank <= 20")
def s02(spark, sf):
    queries = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    return lexical_search(lexical_index(table(spark, sf, "documents")), queries, 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("s03_rrf_topk", f"""WITH {CHANNELS}, m AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS dr, b.rank AS br, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS rrf FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
r AS (SELECT query_id, doc_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dr NULLS LAST, br NULLS LAST, doc_id) AS rank FROM m) SELECT query_id, doc_id, round(rrf, 6) AS rrf, rank FROM r WHERE rank <= 10""", A)
def s03(spark, sf):
    a, b = ranked(spark, sf)
    rows = fuse({"dense": a, "bm25": b}).withColumn("rrf", F.round("rrf", 9))
    order = [F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.asc("doc_id")]
    return top(rows, 10, order, ["query_id"]).select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"), "rank")


@query("s04_rerank_topk", f"""WITH p AS (SELECT conv_id AS query_id, turn AS doc_id, turn AS rank, list_distinct({duck_tokens('text')}) AS pt, first_value(list_distinct({duck_tokens('text')})) OVER (PARTITION BY conv_id ORDER BY turn) AS qt FROM conversations),
s AS (SELECT query_id, doc_id, rank, round(1 / (1 + exp(-(CASE WHEN len(qt) = 0 THEN -4 ELSE len(list_intersect(qt, pt)) / len(qt) * 8.0 - 4.0 END))), 4) AS rerank_score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM s) SELECT query_id, doc_id, rerank_score, rerank_rank FROM r WHERE rerank_rank <= 3""")
def s04(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_id"), F.col("turn").alias("rank"), F.col("text").alias("passage"))
    first = turns.groupBy("query_id").agg(F.min_by("passage", "doc_id").alias("query"))
    return rerank(turns.join(first, "query_id"), 3).select("query_id", "doc_id", "rerank_score", "rerank_rank")


@query("s05_final_sort", "SELECT job_id, id, score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, stage_no, id) AS position FROM applications", A)
def s05(spark, sf):
    w = Window.partitionBy("job_id").orderBy(F.desc("score"), "stage_no", "id")
    return entity(spark, sf, "applications").select("job_id", "id", "score", F.row_number().over(w).cast("long").alias("position"))


@query("s06_vec_topk", f"WITH {DENSE} SELECT query_id, doc_id, rank, round(1 - score, 6) + 0.0 AS distance FROM dr WHERE rank <= 10")
def s06(spark, sf):
    return dense_search(*vectors(spark, sf), 10).select("query_id", "doc_id", "rank", (F.round(1 - F.col("score"), 6) + 0.0).alias("distance"))


@query("s07_stage2_fallback", f"WITH {DENSE} SELECT query_id, doc_id, rank FROM dr WHERE rank <= 5")
def s07(spark, sf):
    found = dense_search(*vectors(spark, sf), 50)  # without a scorer, the first of stage one are taken
    return found.where("rank <= 5").select("query_id", "doc_id", "rank")


@query("s08_slices", "SELECT id, array_to_string(string_split(skills_csv, ',')[1:2], ',') AS first_two, len(string_split(skills_csv, ',')[1:15]) AS n FROM candidates", C)
def s08(spark, sf):
    return entity(spark, sf, "candidates").select("id", F.array_join(F.slice("skills", 1, 2), ",").alias("first_two"), F.size(F.slice("skills", 1, 15)).cast("long").alias("n"))


@query("s09_sort_modes", """WITH m AS (SELECT 'match' AS mode, id, row_number() OVER (ORDER BY balance DESC, id) AS position FROM candidates UNION ALL SELECT 'experience', id, row_number() OVER (ORDER BY years_of_experience DESC, id) FROM candidates
UNION ALL SELECT 'newest', id, row_number() OVER (ORDER BY id DESC) FROM candidates) SELECT * FROM m WHERE position <= 100""", C)
def s09(spark, sf):
    rows = entity(spark, sf, "candidates")
    modes = {"match": [F.desc("balance"), F.asc("id")], "experience": [F.desc("years_of_experience"), F.asc("id")], "newest": [F.desc("id")]}
    out = None
    for mode, order in modes.items():  # a page of each: top-k first, ranks over that alone
        page = rows.orderBy(*order).limit(100).select(F.lit(mode).alias("mode"), "id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))
        out = page if out is None else out.unionByName(page)
    return out


@query("s10_paginate", "SELECT application_id, attempt, evaluated_at, latency_ms FROM audits ORDER BY evaluated_at DESC, application_id, attempt, job_id, reviewer_id, latency_ms LIMIT 20 OFFSET 40", U)
def s10(spark, sf):
    rows = entity(spark, sf, "audits").orderBy(F.desc("evaluated_at"), "application_id", "attempt", "job_id", "reviewer_id", "latency_ms")
    return rows.offset(40).limit(20).select("application_id", "attempt", "evaluated_at", "latency_ms")


@query("s11_score_nulls_last", "SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN id % 7 > 0 THEN score END DESC NULLS LAST, id) AS position FROM applications", A)
def s11(spark, sf):
    w = Window.partitionBy("job_id").orderBy(F.desc_nulls_last(F.when(F.col("id") % 7 > 0, F.col("score"))), "id")
    return entity(spark, sf, "applications").select("job_id", "id", F.row_number().over(w).cast("long").alias("position"))


@query("dml08_vector_search", """WITH k AS (SELECT c.*, embedding FROM candidates c JOIN embeddings e ON e.vec_id = c.id WHERE years_of_experience >= 2 AND (location ILIKE '%a%' OR location ILIKE '%Remote%') AND list_contains(string_split(skills_csv, ','), 'Python')),
d AS (SELECT q.vec_id AS query_id, k.id, k.location, k.skills_csv, round(list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 9) AS score FROM embeddings q, k WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM d) SELECT query_id, id, location, skills_csv, round(score, 4) + 0.0 AS similarity_score, rank FROM r WHERE rank <= 10""", C)
def dml08(spark, sf):
    rows, queries = vectors(spark, sf)
    candidates = entity(spark, sf, "candidates").join(rows.withColumnRenamed("doc_id", "id"), "id")
    found = vector_search(candidates, queries, VectorFilters(min_years=2, location="a", skills=("Python",)))
    return found.select("query_id", "id", "location", "skills_csv", (F.col("similarity_score") + 0.0).alias("similarity_score"), "rank")
