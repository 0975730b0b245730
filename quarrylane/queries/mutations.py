"""Changes: upsert, stages, statuses, notes, cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylane.operators import mutations as M
from quarrylane.queries.projections import icon, top_match
from quarrylane.registry import query
from quarrylane.sources.entities import entity, table

C, J, A = ("candidates",), ("jobs",), ("applications",)


@query("src10_upsert_candidate", "SELECT id, name, stage FROM candidates WHERE id % 5 <> 0 UNION ALL SELECT CASE WHEN id % 2 = 0 THEN id ELSE -id END, concat('new ', name), 'Contacted' FROM candidates WHERE id % 5 = 0 UNION ALL SELECT id, name, stage FROM candidates WHERE id % 5 = 0 AND id % 2 = 1", C)
def src10(spark, sf):
    base = entity(spark, sf, "candidates").select("id", "name", "stage")
    id_ = F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id"))
    changes = base.where("id % 5 = 0").select(id_.alias("id"), F.concat(F.lit("new "), "name").alias("name"), F.lit("Contacted").alias("stage"))
    return M.upsert(base, changes, "id")


@query("dml01_update_stage", "SELECT id, CASE WHEN id % 4 = 0 THEN 'Offer' ELSE stage END AS stage, CASE WHEN id % 4 = 0 THEN 'Offer' ELSE status END AS status FROM candidates", C)
def dml01(spark, sf):
    base = entity(spark, sf, "candidates").select("id", "stage", "status")
    changes = base.where("id % 4 = 0").select("id", F.lit("Offer").alias("stage")).unionByName(base.where("id % 4 = 0").select((-F.col("id") - 1).alias("id"), F.lit("Lost").alias("stage")))
    return M.update_stage(base, changes)


NEW = "CASE id % 3 WHEN 0 THEN 'PAUSED' WHEN 1 THEN 'OPEN' ELSE 'CLOSED' END"


@query("dml02_update_job_status", f"""SELECT id, {NEW} AS status, CASE {NEW} WHEN 'PAUSED' THEN 'PAUSED' ELSE 'ACTIVE' END AS match_status,
CASE WHEN {NEW} = 'PAUSED' THEN 'Analysis Paused' WHEN run_ai_match THEN '95 Top Match' ELSE 'Pending Match' END AS label FROM jobs""", J)
def dml02(spark, sf):
    jobs = entity(spark, sf, "jobs").withColumn("top_match", top_match(F.col("run_ai_match")))
    new = F.when(F.col("id") % 3 == 0, "PAUSED").when(F.col("id") % 3 == 1, "OPEN").otherwise("CLOSED")
    return M.update_job_status(jobs, new).select("id", "status", F.col("top_match.status").alias("match_status"), F.col("top_match.label").alias("label"))


@query("dml03_create_job", """SELECT id, 'OPEN' AS status, skills_csv AS skills, CASE WHEN contains(lower(department), 'data') THEN 'database' WHEN contains(lower(department), 'design') THEN 'design' WHEN contains(lower(department), 'product') THEN 'product' ELSE 'code' END AS icon,
CASE WHEN run_ai_match THEN 95 ELSE 0 END AS score, '2026-01-02T03:04:05Z' AS created_at FROM jobs""", J)
def dml03(spark, sf):
    rows = M.create_jobs(entity(spark, sf, "jobs"), F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"))
    rows = rows.withColumns({"icon": icon("department"), "top_match": top_match(F.col("run_ai_match"))})
    return rows.select("id", "status", F.array_join("required_skills", ",").alias("skills"), "icon", "top_match.score", "created_at")


@query("dml04_add_note", "SELECT conv_id AS id, 1 + count(*) AS notes, min(role) AS first_author FROM conversations GROUP BY conv_id")
def dml04(spark, sf):
    turns = table(spark, sf, "conversations")
    note = lambda author, text, key: M.new_note(author, text, key)
    base = turns.select(F.col("conv_id").alias("id")).distinct().withColumn("notes", F.array(note(F.lit("AI Agent"), F.lit("Parsed."), F.lit("0"))))
    new = turns.select(F.col("conv_id").alias("id"), note(F.col("role"), F.col("text"), F.concat_ws("-", "conv_id", "turn")).alias("note"))
    rows = M.add_notes(base, new)
    return rows.select("id", F.size("notes").cast("long").alias("notes"), F.array_min(F.transform(F.slice("notes", 2, 1 << 20), lambda n: n["author"])).alias("first_author"))


@query("dml05_cascade", "SELECT 'applications' AS child, count(*) AS left_over, 0::BIGINT AS nulled FROM applications WHERE candidate_id % 10 <> 0 UNION ALL SELECT 'audits', count(*), count(*) FILTER (WHERE application_id % 4 = 0) FROM audits", ("applications", "audits"))
def dml05(spark, sf):
    apps, audits = entity(spark, sf, "applications"), entity(spark, sf, "audits")
    gone = entity(spark, sf, "candidates").where("id % 10 = 0").select(F.col("id").alias("candidate_id"))
    kept = M.cascade(apps, gone, "candidate_id").agg(F.count("*").alias("left_over")).select(F.lit("applications").alias("child"), "left_over", F.lit(0).cast("long").alias("nulled"))
    nulled = M.set_null(audits, apps.where("id % 4 = 0").select(F.col("id").alias("application_id")), "application_id")
    return kept.unionByName(nulled.agg(F.count("*").alias("left_over"), F.count_if(F.col("application_id").isNull()).alias("nulled")).select(F.lit("audits").alias("child"), "left_over", "nulled"))
