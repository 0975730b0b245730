"""Numeric and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylane.functions import coercion, numeric, text
from quarrylane.queries.joins import _duck_skills
from quarrylane.registry import query
from quarrylane.sources.entities import entity, table

A, R, C = ("applications",), ("resumes",), ("candidates",)


def neighbours(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@query("m01_cosine", "SELECT x.vec_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) + 0.0 AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def m01(spark, sf):
    return neighbours(spark, sf).select("vec_id", (F.round(numeric.cosine(F.col("a"), F.col("b")), 6) + 0.0).alias("cosine"))


@query("m02_cosine_distance", "SELECT x.vec_id, round(1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) + 0.0 AS distance FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def m02(spark, sf):
    return neighbours(spark, sf).select("vec_id", (F.round(1 - numeric.cosine(F.col("a"), F.col("b")), 6) + 0.0).alias("distance"))


@query("m03_rrf_term", "SELECT id, round(1.0 / (60 + stage_no), 9) AS term FROM applications", A)
def m03(spark, sf):
    return entity(spark, sf, "applications").select("id", F.round(numeric.rrf_term(F.col("stage_no")), 9).alias("term"))


@query("m04_bm25_term", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((ln(60000 - l_partkey % 40000 + 0.5) - ln(l_partkey % 40000 + 0.5)) * l_quantity * 2.5 / (l_quantity + 1.5 * (0.25 + 0.75 * (l_suppkey + 1) / 50.0)), 6) + 0.0 AS weight FROM lineitem""")
def m04(spark, sf):
    df = F.col("l_partkey") % 40000
    weight = numeric.bm25_weight(numeric.bm25_idf(df, F.lit(60000)), F.col("l_quantity"), F.col("l_suppkey") + 1, F.lit(50.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(weight, 6) + 0.0).alias("weight"))


@query("m05_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p FROM events")
def m05(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(numeric.sigmoid((F.col("value") - 50) / 10), 6).alias("p"))


@query("m06_clamp", """WITH s AS (SELECT id, json_extract_string(doc, '$.score') AS s, json_extract_string(doc, '$.overall') AS o FROM llm_json)
SELECT id, CASE WHEN s IS NULL THEN NULL WHEN regexp_matches(s, '^\\s*[+-]?\\d+\\s*$') THEN greatest(1, least(5, CAST(s AS INTEGER))) ELSE 3 END AS score, greatest(0.0, least(100.0, coalesce(TRY_CAST(o AS DOUBLE), 50.0))) AS overall FROM s""", ("llm_json",))
def m06(spark, sf):
    return entity(spark, sf, "llm_json").select("id", coercion.score_1_to_5(F.get_json_object("doc", "$.score")).alias("score"), coercion.score_0_to_100(F.get_json_object("doc", "$.overall")).alias("overall"))


@query("m07_scorecard", rf"""WITH f AS (SELECT id, len({_duck_skills('raw_text')}) AS found, list_min(list_transform(regexp_extract_all(raw_text, '{text.YEAR}', 1), lambda y: CAST(y AS INTEGER))) AS y FROM resumes),
n AS (SELECT id, CASE WHEN found = 0 THEN 6 ELSE found END AS n, CASE WHEN y BETWEEN 1990 AND 2026 AND 2026 - y BETWEEN 1 AND 30 THEN CAST(2026 - y AS DOUBLE) ELSE 4.0 END AS years FROM f),
s AS (SELECT *, least(98, greatest(75, 80 + n * 2)) AS score FROM n)
SELECT id, score, CASE WHEN score >= 92 THEN 'Exceptional Match' WHEN score >= 85 THEN 'Strong Match' ELSE 'Potential Fit' END AS tier, round(least(10.0, 7.5 + n * 0.2), 1) AS depth, round(least(10.0, 7.0 + years * 0.3), 1) AS design, 8.5 AS execution FROM s""", R)
def m07(spark, sf):
    rows = entity(spark, sf, "resumes").select("id", F.size(text.skills(F.col("raw_text"))).alias("n"), text.years_of_experience(F.col("raw_text")).alias("years"))
    score = numeric.match_score(F.col("n"))
    return rows.select("id", score.cast("long").alias("score"), numeric.match_tier(score).alias("tier"), numeric.technical_depth(F.col("n")).alias("depth"), numeric.system_design(F.col("years")).alias("design"), F.lit(8.5).alias("execution"))


@query("m08_tier_of_score", "SELECT id, CASE WHEN score >= 80 THEN 'Strong Fit' WHEN score >= 60 THEN 'Potential Fit' ELSE 'Low Match' END AS tier FROM applications", A)
def m08(spark, sf):
    return entity(spark, sf, "applications").select("id", numeric.tier_of_score(F.col("score")).alias("tier"))


@query("m09_round", "SELECT event_id, round(value / 7, 4) AS four, round(value / 7, 6) AS six FROM events")
def m09(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") / 7, 4).alias("four"), F.round(F.col("value") / 7, 6).alias("six"))


@query("m10_backoff_delay", "SELECT event_id, least(pow(2.0, event_id % 12), 300.0) AS delay, event_id % 12 <= 5 AS retried FROM events")
def m10(spark, sf):
    return table(spark, sf, "events").select("event_id", numeric.backoff(F.col("event_id") % 12).alias("delay"), (F.col("event_id") % 12 <= 5).alias("retried"))


RULE = "contains(target_headline, 'Staff') OR contains(target_headline, 'Senior')"


@query("m11_rule_score", f"SELECT id, CASE WHEN {RULE} THEN 88.0 ELSE 45.0 END AS score, CASE WHEN {RULE} THEN 'Strong Fit' ELSE 'Low Match' END AS tier, CASE WHEN {RULE} THEN 5 ELSE 2 END AS criterion, 1.5 AS weight FROM candidates", C)
def m11(spark, sf):
    score = numeric.rule_score(F.col("target_headline"))
    strong = score >= 80
    return entity(spark, sf, "candidates").select("id", score.alias("score"), F.when(strong, "Strong Fit").otherwise("Low Match").alias("tier"), F.when(strong, 5).otherwise(2).alias("criterion"), F.lit(1.5).alias("weight"))


@query("m12_fallback_eval", "SELECT id, id % 3 = 0 AS failed, CASE WHEN id % 3 = 0 THEN 75.0 ELSE 80.0 END AS match_score, CASE WHEN id % 3 = 0 THEN 'Potential Fit' ELSE 'Strong Fit' END AS qualification_tier FROM candidates", C)
def m12(spark, sf):
    report = F.struct(F.lit(75.0).alias("match_score"), F.lit("Potential Fit").alias("qualification_tier"))
    answered = F.when(F.col("id") % 3 > 0, F.struct(F.lit(80.0).alias("match_score"), F.lit("Strong Fit").alias("qualification_tier")))
    rows = entity(spark, sf, "candidates").withColumn("failed", answered.isNull()).withColumn("r", F.coalesce(answered, report))
    return rows.select("id", "failed", "r.match_score", "r.qualification_tier")


@query("d01_now_format", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def d01(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("d02_touch_updated_at", "SELECT id, CASE WHEN id % 5 = 0 THEN TIMESTAMP '2026-01-02 03:04:05' ELSE applied_at END AS updated_at FROM applications", A)
def d02(spark, sf):
    now = F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")
    return entity(spark, sf, "applications").select("id", F.when(F.col("id") % 5 == 0, now).otherwise(F.col("applied_at")).alias("updated_at"))


@query("d03_relative_time", """WITH m AS (SELECT max(ts) AS last FROM events), d AS (SELECT event_id, date_diff('day', ts, last) AS d FROM events, m)
SELECT event_id, CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 14 THEN concat(d, ' days ago') ELSE concat(d // 7, ' weeks ago') END AS label FROM d""")
def d03(spark, sf):
    events = table(spark, sf, "events")
    rows = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("last")))).select("event_id", F.datediff("last", "ts").alias("d"))
    label = F.when(F.col("d") == 0, "Today").when(F.col("d") == 1, "Yesterday").when(F.col("d") < 14, F.concat(F.col("d").cast("string"), F.lit(" days ago")))
    return rows.select("event_id", label.otherwise(F.concat(F.floor(F.col("d") / 7).cast("string"), F.lit(" weeks ago"))).alias("label"))


@query("d04_year_diff", "SELECT id, 2026 - CAST(year(applied_at) AS BIGINT) AS years FROM applications", A)
def d04(spark, sf):
    return entity(spark, sf, "applications").select("id", (F.lit(2026) - F.year("applied_at")).cast("long").alias("years"))


@query("d05_period_regex", rf"SELECT id, array_to_string(regexp_extract_all(raw_text, '{text.PERIOD}'), '|') AS periods FROM resumes", R)
def d05(spark, sf):
    return entity(spark, sf, "resumes").select("id", F.array_join(text.periods(F.col("raw_text")), "|").alias("periods"))
