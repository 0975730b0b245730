"""Aggregations: corpus statistics, quality, dashboard and analytics tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylane.functions import numeric, text
from quarrylane.plans import quality
from quarrylane.plans.retrieval import fuse, lexical_index, lexical_scores
from quarrylane.queries.joins import CHANNELS, duck_tokens, ranked
from quarrylane.registry import query
from quarrylane.session import table as written
from quarrylane.sources.entities import entity, table

C, J, A, U, R = ("candidates",), ("jobs",), ("applications",), ("audits",), ("resumes",)

BM25 = f"""t AS (SELECT doc_id, unnest({duck_tokens('text')}) AS term FROM documents), l AS (SELECT doc_id, len({duck_tokens('text')}) AS dl FROM documents),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
r AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, s GROUP BY term),
i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({duck_tokens('text')}) AS term FROM benchmark) GROUP BY 1, 2),
b AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) AS score FROM q JOIN i USING (term) JOIN p USING (term) JOIN l USING (doc_id), s GROUP BY 1, 2 HAVING sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) > 0)"""


@query("agg01_corpus_stats", f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf, n, round(avgdl, 6) AS avgdl FROM i, s")
def agg01(spark, sf):
    index = lexical_index(table(spark, sf, "documents"))
    return index.terms.crossJoin(F.broadcast(index.stats)).select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


@query("agg02_bm25_score", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM b")
def agg02(spark, sf):
    queries = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    return lexical_scores(lexical_index(table(spark, sf, "documents")), queries).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("agg03_rrf_sum", f"WITH {CHANNELS} SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2", A)
def agg03(spark, sf):
    a, b = ranked(spark, sf)
    return fuse({"a": a, "b": b}).select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"))


@query("agg04_mean_metrics", """WITH m AS (SELECT job_id % 3 AS system, job_id, count(*) FILTER (WHERE stage_no >= 4) * 1.0 / count(*) AS recall, coalesce(max(1.0 / stage_no) FILTER (WHERE score >= 50), 0) AS mrr FROM applications GROUP BY 1, 2)
SELECT system, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, count(*) AS queries FROM m GROUP BY system""", A)
def agg04(spark, sf):
    per = entity(spark, sf, "applications").groupBy((F.col("job_id") % 3).alias("system"), "job_id").agg(
        (F.count_if(F.col("stage_no") >= 4) / F.count("*")).alias("recall"), F.coalesce(F.max(F.when(F.col("score") >= 50, 1.0 / F.col("stage_no"))), F.lit(0.0)).alias("mrr")
    )
    return per.groupBy("system").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count("*").alias("queries"))


@query("agg05_latency_np", "SELECT model, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM audits GROUP BY model", U)
def agg05(spark, sf):
    rows = entity(spark, sf, "audits").select("model", "latency_ms")
    p95 = quality.percentile(rows, "latency_ms", ["model"], 0.95)
    return rows.groupBy("model").agg(F.round(F.avg("latency_ms"), 6).alias("mean_ms")).join(p95.select("model", F.round("value", 6).alias("p95_ms")), "model")


@query("agg05_stored_sketches", """WITH w AS (SELECT model, latency_ms, percent_rank() OVER (PARTITION BY model ORDER BY latency_ms) AS low, cume_dist() OVER (PARTITION BY model ORDER BY latency_ms) AS high FROM audits)
SELECT model, count(*) AS n, true AS close FROM w GROUP BY model""", U)
def agg05_sketches(spark, sf):
    """Sketches by month, stored, merged by model: whether 0.95 is within 0.02 of the share of values up to the sketch's p95."""
    rows = entity(spark, sf, "audits").select("model", "latency_ms", F.date_trunc("month", "evaluated_at").alias("month"))
    stored = written(quality.sketches(rows, "latency_ms", ["model", "month"]))
    p95 = quality.quantiles_of(stored, ["model"], {"p95": 0.95})
    share = F.avg(F.when(F.col("latency_ms") <= F.col("p95"), 1.0).otherwise(0.0))
    return rows.join(F.broadcast(p95), "model").groupBy("model").agg(F.count("*").alias("n"), (F.abs(share - 0.95) <= 0.02).alias("close"))  # a row for each model


@query("agg06_latency_stats", """SELECT model, round(avg(latency_ms), 6) AS mean, round(quantile_cont(latency_ms, 0.5), 6) AS median, min(latency_ms) AS least, max(latency_ms) AS largest,
list_sort(list(latency_ms))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95 FROM audits GROUP BY model""", U)
def agg06(spark, sf):
    rows = quality.latency(entity(spark, sf, "audits"), "latency_ms", ["model"])
    return rows.select("model", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "least", "largest", "p95")


@query("agg07_gate_rates", """SELECT count(*) AS total, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS success_rate,
count(*) FILTER (WHERE event_type = 'error' AND (contains(lower(props), 'rate limit') OR contains(props, '42'))) AS rate_limited, avg(value) <= 3000 AND count(*) FILTER (WHERE contains(props, '429')) = 0 AS passed FROM events""")
def agg07(spark, sf):
    error = F.col("event_type") == "error"
    limited = error & (F.lower("props").contains("rate limit") | F.col("props").contains("42"))
    return table(spark, sf, "events").agg(
        F.count("*").alias("total"), F.avg(F.when(~error, 1.0).otherwise(0.0)).alias("success_rate"), F.count_if(limited).alias("rate_limited"),
        ((F.avg("value") <= 3000) & (F.count_if(F.col("props").contains("429")) == 0)).alias("passed"),
    )


@query("agg08_pii_accuracy", rf"""WITH t AS (SELECT c_custkey AS id, concat('user', c_custkey, '@') AS x, raw_text FROM resumes JOIN customer ON c_custkey = id)
SELECT count(*) FILTER (WHERE NOT contains(regexp_replace(raw_text, '{text.EMAIL}', '[EMAIL_ADDRESS]', 'g'), x)) * 100.0 / count(*) AS accuracy, count(*) AS total FROM t""", R)
def agg08(spark, sf):
    rows = entity(spark, sf, "resumes").withColumn("truth", F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@")))
    return rows.agg((F.count_if(~F.regexp_replace("raw_text", text.EMAIL, "[EMAIL_ADDRESS]").contains(F.col("truth"))) * 100.0 / F.count("*")).alias("accuracy"), F.count("*").alias("total"))


@query("agg09_funnel_counts", "SELECT job_id, count(*) AS retrieved, least(count(*), 20) AS reranked FROM applications GROUP BY job_id", A)
def agg09(spark, sf):
    return entity(spark, sf, "applications").groupBy("job_id").agg(F.count("*").alias("retrieved"), F.least(F.count("*"), F.lit(20)).alias("reranked"))


@query("agg10_kpi_cards", """WITH m AS (SELECT max(applied_at) AS last FROM applications),
w AS (SELECT CASE WHEN applied_at > last - INTERVAL 30 DAY THEN 'now' WHEN applied_at > last - INTERVAL 60 DAY THEN 'before' END AS period, * FROM applications, m),
k AS (SELECT count(DISTINCT candidate_id) FILTER (WHERE period = 'now') AS cn, count(DISTINCT candidate_id) FILTER (WHERE period = 'before') AS cb,
count(*) FILTER (WHERE period = 'now' AND stage = 'Offer') AS onow, count(*) FILTER (WHERE period = 'before' AND stage = 'Offer') AS obefore FROM w)
SELECT 'active_jobs' AS card, count(*) FILTER (WHERE status = 'OPEN') AS value, 0::BIGINT AS change FROM jobs UNION ALL SELECT 'candidates', cn, cn - cb FROM k UNION ALL SELECT 'open_offers', onow, onow - obefore FROM k""", ("jobs", "applications"))
def agg10(spark, sf):
    apps = entity(spark, sf, "applications")
    w = apps.crossJoin(F.broadcast(apps.agg(F.max("applied_at").alias("last"))))
    now = F.col("applied_at") > F.col("last") - F.expr("INTERVAL 30 DAYS")
    before = ~now & (F.col("applied_at") > F.col("last") - F.expr("INTERVAL 60 DAYS"))
    offer = F.col("stage") == "Offer"
    k = w.agg(F.count_distinct(F.when(now, F.col("candidate_id"))).alias("cn"), F.count_distinct(F.when(before, F.col("candidate_id"))).alias("cb"), F.count_if(now & offer).alias("on"), F.count_if(before & offer).alias("ob"))
    jobs = entity(spark, sf, "jobs").agg(F.count_if(F.col("status") == "OPEN").alias("value")).select(F.lit("active_jobs").alias("card"), "value", F.lit(0).cast("long").alias("change"))
    cards = k.select(F.inline(F.array(F.struct(F.lit("candidates").alias("card"), F.col("cn").alias("value"), (F.col("cn") - F.col("cb")).alias("change")), F.struct(F.lit("open_offers").alias("card"), F.col("on").alias("value"), (F.col("on") - F.col("ob")).alias("change")))))
    return jobs.unionByName(cards)


def weekly(events):
    """Counts of the last eight weeks that have any, W1 to W8, and whether each is the peak."""
    per = events.groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n")).orderBy(F.desc("week")).limit(8)
    w = Window.orderBy("week")  # eight rows
    return per.select(F.concat(F.lit("W"), F.row_number().over(w).cast("string")).alias("week"), "n", (F.col("n") == F.max("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("is_peak"))


WEEKLY = "w AS (SELECT date_trunc('week', ts) AS week, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 8)"


@query("agg11_weekly_volume", f"WITH {WEEKLY} SELECT concat('W', row_number() OVER (ORDER BY week)) AS week, n, n = max(n) OVER () AS is_peak FROM w")
def agg11(spark, sf):
    return weekly(table(spark, sf, "events"))


def hiring_funnel(apps):
    """How many reached each stage, and what share of those of the stage before."""
    stages = [("Applied", 1), ("Screened", 2), ("Interview", 3), ("Offer", 4), ("Hired", 5)]
    reached = apps.agg(*[F.count_if(F.col("stage_no") >= n).alias(s) for s, n in stages])
    rows = reached.select(F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(n).alias("stage_no"), F.col(s).alias("n")) for s, n in stages])))
    return rows.withColumn("conversion", F.round(F.col("n") * 100.0 / F.lag("n").over(Window.orderBy("stage_no")), 2))  # five rows


FUNNEL = "f AS (SELECT s AS stage, k AS stage_no, count(*) FILTER (WHERE stage_no >= k) AS n FROM applications, (VALUES ('Applied', 1), ('Screened', 2), ('Interview', 3), ('Offer', 4), ('Hired', 5)) v(s, k) GROUP BY 1, 2)"


@query("agg12_hiring_funnel", f"WITH {FUNNEL} SELECT stage, stage_no, n, round(n * 100.0 / lag(n) OVER (ORDER BY stage_no), 2) AS conversion FROM f", A)
def agg12(spark, sf):
    return hiring_funnel(entity(spark, sf, "applications"))


@query("agg13_match_rate", "SELECT round(avg(CASE WHEN score >= 60 THEN 100.0 ELSE 0 END), 4) AS matched, round(100 - avg(CASE WHEN score >= 60 THEN 100.0 ELSE 0 END), 4) AS not_matched FROM applications", A)
def agg13(spark, sf):
    rate = F.avg(F.when(F.col("score") >= 60, 100.0).otherwise(0.0))
    return entity(spark, sf, "applications").agg(F.round(rate, 4).alias("matched"), F.round(100 - rate, 4).alias("not_matched"))


@query("agg14_pipeline_board", "SELECT stage, count(*) AS n, min(id) AS first_id, max(score) AS best FROM applications GROUP BY stage", A)
def agg14(spark, sf):
    return entity(spark, sf, "applications").groupBy("stage").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("score").alias("best"))


@query("agg15_time_to_hire", """WITH h AS (SELECT a.id, date_trunc('quarter', applied_at) AS quarter, date_diff('day', applied_at, min(evaluated_at)) AS days FROM applications a JOIN audits u ON u.application_id = a.id AND evaluated_at >= applied_at WHERE stage_no >= 4 GROUP BY a.id, applied_at)
SELECT quarter, round(avg(days), 4) AS days, count(*) AS n FROM h GROUP BY quarter""", ("applications", "audits"))
def agg15(spark, sf):
    apps = entity(spark, sf, "applications").where("stage_no >= 4").select("id", "applied_at")
    done = entity(spark, sf, "audits").select(F.col("application_id").alias("id"), "evaluated_at")
    first = apps.join(done, "id").where("evaluated_at >= applied_at").groupBy("id", "applied_at").agg(F.min("evaluated_at").alias("at"))
    return first.groupBy(F.date_trunc("quarter", "applied_at").alias("quarter")).agg(F.round(F.avg(F.datediff("at", "applied_at")), 4).alias("days"), F.count("*").alias("n"))


@query("agg16_source_effectiveness", "SELECT source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share, round(avg(CASE WHEN a.stage = 'Hired' THEN 100.0 ELSE 0 END), 4) AS hire_rate FROM applications a JOIN candidates c ON c.id = a.candidate_id GROUP BY source", ("applications", "candidates"))
def agg16(spark, sf):
    c = entity(spark, sf, "candidates").select(F.col("id").alias("candidate_id"), "source")
    per = entity(spark, sf, "applications").join(c, "candidate_id").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("stage") == "Hired", 100.0).otherwise(0.0)), 4).alias("hire_rate"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("source", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("share"), "hire_rate")


@query("agg17_score_vs_outcome", "SELECT CAST(floor(score / 20) AS BIGINT) AS bucket, stage, count(*) AS n, (SELECT round(corr(score, stage_no), 6) FROM applications) AS r FROM applications GROUP BY 1, 2", A)
def agg17(spark, sf):
    rows = entity(spark, sf, "applications")
    r = rows.agg(F.round(F.corr("score", F.col("stage_no").cast("double")), 6).alias("r"))
    return rows.groupBy(F.floor(F.col("score") / 20).alias("bucket"), "stage").agg(F.count("*").alias("n")).crossJoin(F.broadcast(r))


@query("agg18_facet_counts", "SELECT skill, count(*) AS n FROM (SELECT unnest(string_split(skills_csv, ',')) AS skill FROM candidates) GROUP BY skill", C)
def agg18(spark, sf):
    return entity(spark, sf, "candidates").select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))


@query("agg19_chart_max", f"WITH {WEEKLY} SELECT week, n, greatest((SELECT max(n) FROM w), 135) AS top, round(n * 100.0 / greatest((SELECT max(n) FROM w), 135), 4) AS height FROM w")
def agg19(spark, sf):
    per = table(spark, sf, "events").groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n")).orderBy(F.desc("week")).limit(8)
    top = per.agg(F.greatest(F.max("n"), F.lit(135)).alias("top"))
    return per.crossJoin(F.broadcast(top)).select("week", "n", "top", F.round(F.col("n") * 100.0 / F.col("top"), 4).alias("height"))


@query("agg20_earliest_year", rf"SELECT id, list_min(list_transform(regexp_extract_all(raw_text, '{text.YEAR}', 1), lambda y: CAST(y AS INTEGER))) AS earliest FROM resumes", R)
def agg20(spark, sf):
    return entity(spark, sf, "resumes").select("id", F.array_min(text.years(F.col("raw_text"))).alias("earliest"))


@query("agg21_tenure", """WITH t AS (SELECT application_id, attempt, prompt_tokens / 100 AS months FROM audits)
SELECT application_id, CAST(max(months) AS DOUBLE) AS longest, round(avg(months), 6) AS average, round(sum(months) / 12, 6) AS years FROM t GROUP BY application_id""", U)
def agg21(spark, sf):
    months = F.col("prompt_tokens") / 100
    return entity(spark, sf, "audits").groupBy("application_id").agg(F.max(months).alias("longest"), F.round(F.avg(months), 6).alias("average"), F.round(F.sum(months) / 12, 6).alias("years"))


@query("agg22_weighted_score", "SELECT id, round((stage_no * 2.0 + 3 * 0.5 + (id % 5 + 1) * 1.5) / (4.0 * 5) * 100, 6) AS overall FROM applications", A)
def agg22(spark, sf):
    scores = F.array(F.col("stage_no").cast("double"), F.lit(3.0), (F.col("id") % 5 + 1).cast("double"))
    return entity(spark, sf, "applications").select("id", F.round(numeric.weighted_score(scores, F.array(F.lit(2.0), F.lit(0.5), F.lit(1.5))), 6).alias("overall"))


@query("agg23_audit_rollup", "SELECT model, tier, count(*) AS n, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens, round(avg(latency_ms), 4) AS latency FROM audits GROUP BY ROLLUP (model, tier)", U)
def agg23(spark, sf):
    return entity(spark, sf, "audits").rollup("model", "tier").agg(F.count("*").alias("n"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.round(F.avg("latency_ms"), 4).alias("latency"))


@query("agg24_today_counters", """WITH t AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), m AS (SELECT CAST(max(ts) AS DATE) AS d FROM events)
SELECT (SELECT count(*) FROM events, m WHERE CAST(ts AS DATE) = d) AS today_evaluations, (SELECT count(*) FROM t WHERE k = 1 AND event_type IN ('view', 'click')) AS processing""")
def agg24(spark, sf):
    events = table(spark, sf, "events")
    day = F.broadcast(events.agg(F.to_date(F.max("ts")).alias("d")))
    today = events.crossJoin(day).agg(F.count_if(F.to_date("ts") == F.col("d")).alias("today_evaluations"))
    last = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return today.crossJoin(last.agg(F.count_if(F.col("state").isin("view", "click")).alias("processing")))
