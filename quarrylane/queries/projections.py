"""Projections: result rows, formatted texts, defaults and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylane.operators.audits import audit_rows
from quarrylane.operators.mutations import create_jobs, new_note
from quarrylane.plans.retrieval import format_candidate
from quarrylane.registry import query
from quarrylane.sources.entities import entity, table

C, J, A = ("candidates",), ("jobs",), ("applications",)
#: Fixed value: what stands before a query when it is embedded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


@query("p01_search_result", "SELECT id, name AS anonymized_name, target_headline, years_of_experience, location, highest_education, skills_csv, round(balance / 10000, 4) AS similarity_score FROM candidates", C)
def p01(spark, sf):
    return entity(spark, sf, "candidates").select(
        "id", F.col("name").alias("anonymized_name"), "target_headline", "years_of_experience", "location", "highest_education", F.array_join("skills", ",").alias("skills_csv"),
        F.round(F.col("balance") / 10000, 4).alias("similarity_score"),
    )


@query("p02_format_candidate", """SELECT id, CASE WHEN id % 4 = 0 THEN name ELSE concat('Role: ', target_headline, ' | Experience: ', CAST(CAST(years_of_experience * 10 AS BIGINT) AS STRING), ' years | Core Competencies: ',
array_to_string(string_split(skills_csv, ',')[1:15], ', '), ' | Summary: ', coalesce(highest_education, '')) END AS passage FROM candidates""", C)
def p02(spark, sf):
    own = F.when(F.col("id") % 4 == 0, F.col("name")).otherwise("")
    tenths = (F.col("years_of_experience") * 10).cast("long")
    return entity(spark, sf, "candidates").select("id", format_candidate(own, F.col("target_headline"), tenths, F.col("skills"), F.col("highest_education")).alias("passage"))


@query("p03_hybrid_row", "SELECT id, round(1.0 / (60 + stage_no) + 1.0 / (61 + id % 50), 6) AS rrf_score, stage_no AS dense_rank, CASE WHEN id % 3 > 0 THEN id % 50 END AS bm25_rank, concat('stage=', stage) AS metadata FROM applications", A)
def p03(spark, sf):
    rrf = F.lit(1.0) / (60 + F.col("stage_no")) + F.lit(1.0) / (61 + F.col("id") % 50)
    return entity(spark, sf, "applications").select("id", F.round(rrf, 6).alias("rrf_score"), F.col("stage_no").alias("dense_rank"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("bm25_rank"), F.concat(F.lit("stage="), "stage").alias("metadata"))


@query("p04_match_row", "SELECT id, coalesce(CASE WHEN id % 4 > 0 THEN score / 100 END, 0.95) AS rerank_score, coalesce(CASE WHEN id % 4 > 0 THEN stage_no END, 1) AS rerank_rank, CASE WHEN score >= 60 THEN 'Strong Fit' ELSE 'Low Match' END AS tier FROM applications", A)
def p04(spark, sf):
    known = F.col("id") % 4 > 0
    report = F.struct(F.when(F.col("score") >= 60, "Strong Fit").otherwise("Low Match").alias("tier"))
    rows = entity(spark, sf, "applications").withColumn("evaluation", report)
    return rows.select("id", F.coalesce(F.when(known, F.col("score") / 100), F.lit(0.95)).alias("rerank_score"), F.coalesce(F.when(known, F.col("stage_no")), F.lit(1)).alias("rerank_rank"), F.col("evaluation.tier").alias("tier"))


@query("p05_query_text", "SELECT id, concat('Title: ', title, chr(10), 'Requirements: ', job_description) AS query_text FROM jobs", J)
def p05(spark, sf):
    return entity(spark, sf, "jobs").select("id", F.concat(F.lit("Title: "), "title", F.lit("\nRequirements: "), "job_description").alias("query_text"))


@query("p06_query_prefix", f"SELECT item_id, concat('{QUERY_PREFIX}', text) AS query FROM benchmark")
def p06(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.concat(F.lit(QUERY_PREFIX), "text").alias("query"))


@query("p07_embedding_text", "SELECT id, concat_ws('. ', target_headline, highest_education) AS passage FROM candidates", C)
def p07(spark, sf):
    return entity(spark, sf, "candidates").select("id", F.concat_ws(". ", "target_headline", "highest_education").alias("passage"))


@query("p08_profile_to_row", "SELECT id, coalesce(highest_education, 'Not Specified') AS highest_education, concat(skills_csv, ',Git,', 'SQL') AS core_skills FROM candidates", C)
def p08(spark, sf):
    education = F.when(F.col("highest_education").isNull(), F.array().cast("array<struct<degree:string>>")).otherwise(F.array(F.struct(F.col("highest_education").alias("degree"))))
    profile = entity(spark, sf, "candidates").select("id", education.alias("education"), F.col("skills").alias("languages"), F.array(F.lit("Git"), F.lit("SQL")).alias("frameworks"))
    return profile.select("id", F.coalesce(F.get("education", F.lit(0))["degree"], F.lit("Not Specified")).alias("highest_education"), F.array_join(F.concat("languages", "frameworks"), ",").alias("core_skills"))


@query("p09_ingest_summary", "SELECT id, 'SUCCESS' AS status, CAST(len(string_split(skills_csv, ',')) AS BIGINT) AS skills_count, CASE WHEN id % 2 = 0 THEN 'simple' ELSE 'deep' END AS parsing_engine FROM candidates", C)
def p09(spark, sf):
    summary = F.struct(F.lit("SUCCESS").alias("status"), F.size("skills").cast("long").alias("skills_count"), F.when(F.col("id") % 2 == 0, "simple").otherwise("deep").alias("parsing_engine"))
    return entity(spark, sf, "candidates").select("id", summary.alias("s")).select("id", "s.*")


@query("p10_audit_row", "SELECT id, score AS overall_match_score, CASE WHEN score >= 80 THEN 'Strong Fit' WHEN score >= 60 THEN 'Potential Fit' ELSE 'Low Match' END AS qualification_tier, concat('Why ', stage, '?|Why ', status, '?') AS questions, 'rules' AS llm_model, 0 AS latency_ms FROM applications", A)
def p10(spark, sf):
    ask = lambda c: F.struct(F.concat(F.lit("Why "), F.col(c), F.lit("?")).alias("question"), F.lit("Technical Deep Dive").alias("category"))
    reports = entity(spark, sf, "applications").select("id", F.col("score").alias("overall_match_score"), F.array(ask("stage"), ask("status")).alias("suggested_interview_questions"))
    rows = audit_rows(reports)
    return rows.select("id", "overall_match_score", "qualification_tier", F.array_join("recommended_interview_questions", "|").alias("questions"), "llm_model", "latency_ms")


@query("p11_eval_prompt", "SELECT id, concat('--- JOB DESCRIPTION ---', chr(10), job_description, chr(10), chr(10), '--- CANDIDATE PROFILE ---', chr(10), title, chr(10)) AS prompt FROM jobs", J)
def p11(spark, sf):
    return entity(spark, sf, "jobs").select("id", F.concat(F.lit("--- JOB DESCRIPTION ---\n"), "job_description", F.lit("\n\n--- CANDIDATE PROFILE ---\n"), "title", F.lit("\n")).alias("prompt"))


def icon(department):
    """The first keyword in the department decides."""
    low = F.lower(department)
    return F.when(low.contains("data"), "database").when(low.contains("design"), "design").when(low.contains("product"), "product").otherwise("code")


@query("p12_icon_type", "SELECT id, CASE WHEN contains(lower(department), 'data') THEN 'database' WHEN contains(lower(department), 'design') THEN 'design' WHEN contains(lower(department), 'product') THEN 'product' ELSE 'code' END AS icon_type FROM jobs", J)
def p12(spark, sf):
    return entity(spark, sf, "jobs").select("id", icon("department").alias("icon_type"))


def top_match(run):
    made = lambda score, label, last: F.struct(F.lit(score).alias("score"), F.lit(label).alias("label"), F.lit(last).alias("last_run"), F.lit("ACTIVE").alias("status"))
    return F.when(run, made(95, "95 Top Match", "Just now")).otherwise(made(0, "Pending Match", "-"))


@query("p13_top_match", "SELECT id, CASE WHEN run_ai_match THEN 95 ELSE 0 END AS score, CASE WHEN run_ai_match THEN '95 Top Match' ELSE 'Pending Match' END AS label, CASE WHEN run_ai_match THEN 'Just now' ELSE '-' END AS last_run, 'ACTIVE' AS status FROM jobs", J)
def p13(spark, sf):
    return entity(spark, sf, "jobs").select("id", top_match(F.col("run_ai_match")).alias("t")).select("id", "t.*")


@query("p14_live_map", """SELECT id, coalesce(nullif(target_headline, ''), 'Software Engineer') AS role, coalesce(nullif(location, ''), 'Remote') AS location, coalesce(nullif(CAST(id % 4 * 30 AS BIGINT), 0), 92) AS match_score,
CAST(floor(coalesce(nullif(years_of_experience, 0), 4) + 0.5) AS BIGINT) AS experience_years, upper(substr(name, 1, 2)) AS avatar, 'Active' AS status FROM candidates""", C)
def p14(spark, sf):
    given = lambda c, none, default: F.coalesce(F.nullif(c, F.lit(none)), F.lit(default))
    return entity(spark, sf, "candidates").select(
        "id", given(F.col("target_headline"), "", "Software Engineer").alias("role"), given(F.col("location"), "", "Remote").alias("location"),
        given((F.col("id") % 4 * 30).cast("long"), 0, 92).alias("match_score"), F.floor(given(F.col("years_of_experience"), 0, 4) + 0.5).alias("experience_years"),
        F.upper(F.substring("name", 1, 2)).alias("avatar"), F.lit("Active").alias("status"),
    )


@query("p15_score_percent", "SELECT id, c.name AS category, c.score / 10 * 100 AS percent FROM (SELECT id, unnest([{'name': 'depth', 'score': score / 10}, {'name': 'stage', 'score': CAST(stage_no AS DOUBLE)}]) AS c FROM applications)", A)
def p15(spark, sf):
    part = lambda name, score: F.struct(F.lit(name).alias("name"), score.alias("score"), F.lit(10.0).alias("max_score"))
    rows = entity(spark, sf, "applications").select("id", F.explode(F.array(part("depth", F.col("score") / 10), part("stage", F.col("stage_no").cast("double")))).alias("c"))
    return rows.select("id", F.col("c.name").alias("category"), (F.col("c.score") / F.col("c.max_score") * 100).alias("percent"))


@query("p16_new_note", "SELECT conv_id, turn, coalesce(nullif(upper(array_to_string(list_transform(list_filter(string_split_regex(concat(role, ' of turn ', turn), '\\s+'), lambda w: w <> ''), lambda w: w[1]), '')), ''), 'RA') AS initials, 'Recruiter' AS role, length(text) AS n FROM conversations")
def p16(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("author", F.concat("role", F.lit(" of turn "), F.col("turn").cast("string")))
    rows = rows.select("conv_id", "turn", new_note(F.col("author"), F.col("text"), F.concat_ws("-", "conv_id", "turn")).alias("note"))
    return rows.select("conv_id", "turn", "note.initials", "note.role", F.length("note.content").cast("long").alias("n"))


@query("p17_job_defaults", "SELECT id, 'OPEN' AS status, 0 AS candidates_count, 0.4 AS technical, 0.4 AS design, 0.2 AS leadership, '2026-01-02' AS posted_date FROM jobs", J)
def p17(spark, sf):
    rows = create_jobs(entity(spark, sf, "jobs"), F.lit("2026-01-02 03:04:05").cast("timestamp"))
    w = F.col("structured_criteria")
    return rows.select("id", "status", "candidates_count", w["technical_depth_weight"].alias("technical"), w["system_design_weight"].alias("design"), w["leadership_weight"].alias("leadership"), "posted_date")
