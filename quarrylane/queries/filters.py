"""Filters and predicates over candidates, jobs and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarrylane.plans.retrieval import VectorFilters
from quarrylane.registry import query
from quarrylane.sources.entities import entity, table

C, J = ("candidates",), ("jobs",)
SHOW = ("id", "years_of_experience", "location", "highest_education")


def passing(df, filters: VectorFilters, *columns: str):
    return df.where(reduce(lambda a, b: a & b, filters.predicates(), F.lit(True))).select(*columns)


@query("f01_vec_not_null", "SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL")
def f01(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", "label")


@query("f02_min_exp", "SELECT id, years_of_experience FROM candidates WHERE years_of_experience >= 5", C)
def f02(spark, sf):
    return passing(entity(spark, sf, "candidates"), VectorFilters(min_years=5), "id", "years_of_experience")


@query("f03_max_exp", "SELECT id, years_of_experience FROM candidates WHERE years_of_experience <= 0.7", C)
def f03(spark, sf):
    return passing(entity(spark, sf, "candidates"), VectorFilters(max_years=0.7), "id", "years_of_experience")


@query("f04_location_or_remote", "SELECT id, location FROM candidates WHERE location ILIKE '%asia%' OR location ILIKE '%Remote%'", C)
def f04(spark, sf):
    return passing(entity(spark, sf, "candidates"), VectorFilters(location=" asia "), "id", "location")


@query("f05_education_any", "SELECT id, highest_education FROM candidates WHERE highest_education ILIKE '%master%' OR highest_education ILIKE '%PHD%'", C)
def f05(spark, sf):
    return passing(entity(spark, sf, "candidates"), VectorFilters(education=("master", "PHD")), "id", "highest_education")


@query("f06_skills_contain_all", "SELECT id, skills_csv FROM candidates WHERE list_has_all(string_split(skills_csv, ','), ['Python', 'Docker'])", C)
def f06(spark, sf):
    return passing(entity(spark, sf, "candidates"), VectorFilters(skills=("Python", "Docker")), "id", "skills_csv")


@query("f07_conj", """SELECT id, years_of_experience, location, highest_education FROM candidates WHERE years_of_experience >= 2 AND years_of_experience <= 12
AND (location ILIKE '%america%' OR location ILIKE '%Remote%') AND highest_education ILIKE '%science%' AND list_contains(string_split(skills_csv, ','), 'Go')""", C)
def f07(spark, sf):
    return passing(entity(spark, sf, "candidates"), VectorFilters(2, 12, "america", ("science",), ("Go",)), *SHOW)


def equals(column: str, value: str):
    """Case-insensitive equality; ALL switches it off."""
    return F.lit(True) if value.upper() == "ALL" else F.lower(column) == value.lower()


@query("f08_stage_eq", "SELECT id, stage FROM candidates WHERE lower(stage) = 'interview'", C)
def f08(spark, sf):
    return entity(spark, sf, "candidates").where(equals("stage", "INTERVIEW")).where(equals("status", "ALL")).select("id", "stage")


@query("f09_skill_substr_any", "SELECT id, skills_csv FROM candidates WHERE len(list_filter(string_split(skills_csv, ','), lambda s: contains(lower(s), 'ker'))) > 0", C)
def f09(spark, sf):
    return entity(spark, sf, "candidates").where(F.exists("skills", lambda s: F.lower(s).contains("ker"))).select("id", "skills_csv")


def mentions(word: str, columns: tuple[str, ...], skills: bool = True):
    """The word in any of the columns or skills, whatever its case."""
    word = word.lower()
    out = reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(word), F.lit(False)) for c in columns])
    return out | F.exists("skills", lambda s: F.lower(s).contains(word)) if skills else out


@query("f10_cand_search", "SELECT id, name FROM candidates WHERE contains(lower(name), 'af') OR contains(lower(target_headline), 'af') OR contains(lower(location), 'af') OR contains(lower(skills_csv), 'af')", C)
def f10(spark, sf):
    return entity(spark, sf, "candidates").where(mentions("AF", ("name", "target_headline", "location"))).select("id", "name")


@query("f11_job_status_eq", "SELECT id, status FROM jobs WHERE upper(status) = 'OPEN'", J)
def f11(spark, sf):
    return entity(spark, sf, "jobs").where(equals("status", "open")).select("id", "status")


@query("f12_job_dept_eq", "SELECT id, department FROM jobs WHERE lower(department) = 'engineering'", J)
def f12(spark, sf):
    return entity(spark, sf, "jobs").where(equals("department", "ENGINEERING")).select("id", "department")


@query("f13_job_search", "SELECT id, title FROM jobs WHERE contains(lower(title), 'ring') OR contains(lower(department), 'ring') OR contains(lower(location), 'ring') OR contains(lower(skills_csv), 'ring')", J)
def f13(spark, sf):
    return entity(spark, sf, "jobs").where(mentions("ring", ("title", "department", "location"))).select("id", "title")


@query("f14_point_lookup", "SELECT id, title, department, status FROM jobs WHERE id = 42 LIMIT 1", J)
def f14(spark, sf):
    return entity(spark, sf, "jobs").where("id = 42").limit(1).select("id", "title", "department", "status")


@query("f15_lookup_with_default", """WITH d AS (SELECT * FROM candidates WHERE id = 0)
SELECT e.event_id, e.user_id * 97 AS id, coalesce(c.target_headline, d.target_headline) AS target_headline, coalesce(c.stage, d.stage) AS stage
FROM events e LEFT JOIN candidates c ON c.id = e.user_id * 97 CROSS JOIN d""", C)
def f15(spark, sf):
    rows = entity(spark, sf, "candidates")
    default = rows.where("id = 0").select(F.col("target_headline").alias("dh"), F.col("stage").alias("ds"))  # one row
    asked = table(spark, sf, "events").select("event_id", (F.col("user_id") * 97).alias("id"))
    found = asked.join(rows.select("id", "target_headline", "stage"), "id", "left").crossJoin(F.broadcast(default))
    return found.select("event_id", "id", F.coalesce("target_headline", "dh").alias("target_headline"), F.coalesce("stage", "ds").alias("stage"))


@query("f18_talent_pool", "SELECT id, name, status FROM candidates WHERE (contains(lower(name), 'java') OR contains(lower(target_headline), 'java') OR contains(lower(skills_csv), 'java')) AND status IN ('Active', 'Placed')", C)
def f18(spark, sf):
    chosen = ("Active", "Placed")  # none chosen: all
    return entity(spark, sf, "candidates").where(mentions("java", ("name", "target_headline"))).where(F.col("status").isin(*chosen) if chosen else F.lit(True)).select("id", "name", "status")


@query("f19_audit_search", """SELECT application_id, attempt, model, evaluated_at FROM audits JOIN candidates ON candidates.id = reviewer_id JOIN jobs ON jobs.id = job_id
WHERE (contains(lower(name), '00042') OR contains(lower(title), 'blue') OR contains(lower(brand), '#21')) AND model = 'R' AND evaluated_at >= (SELECT max(evaluated_at) FROM audits) - INTERVAL 365 DAY""", ("candidates", "jobs", "audits"))
def f19(spark, sf):
    audits = entity(spark, sf, "audits")
    last = audits.agg(F.max("evaluated_at").alias("last"))
    recent = audits.where("model = 'R'").crossJoin(F.broadcast(last)).where(F.col("evaluated_at") >= F.col("last") - F.expr("INTERVAL 365 DAYS"))
    who = entity(spark, sf, "candidates").select(F.col("id").alias("reviewer_id"), "name")
    what = entity(spark, sf, "jobs").select(F.col("id").alias("job_id"), "title", "brand")
    hit = F.lower("name").contains("00042") | F.lower("title").contains("blue") | F.lower("brand").contains("#21")
    return recent.join(who, "reviewer_id").join(what, "job_id").where(hit).select("application_id", "attempt", "model", "evaluated_at")


@query("f20_member_search", "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '07') OR contains(lower('m' || s_suppkey || '@mail.example.com'), 'm4')")
def f20(spark, sf):
    rows = table(spark, sf, "supplier").withColumn("email", F.concat(F.lit("m"), F.col("s_suppkey").cast("string"), F.lit("@mail.example.com")))
    return rows.where(F.lower("s_name").contains("07") | F.lower("email").contains("m4")).select("s_suppkey", "s_name")


@query("f21_exp_bucket", """SELECT CASE WHEN years_of_experience < 3 THEN '0-2' WHEN years_of_experience < 6 THEN '3-5' WHEN years_of_experience <= 10 THEN '6-10' ELSE '10+' END AS bucket, count(*) AS n
FROM candidates GROUP BY 1""", C)
def f21(spark, sf):
    years = F.col("years_of_experience")
    bucket = F.when(years < 3, "0-2").when(years < 6, "3-5").when(years <= 10, "6-10").otherwise("10+")
    return entity(spark, sf, "candidates").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("f22_time_range", """WITH l AS (SELECT max(ts) AS last FROM events) SELECT r AS range_name, count(*) AS n FROM events, l,
(VALUES ('day', INTERVAL 1 DAY), ('week', INTERVAL 7 DAY), ('month', INTERVAL 30 DAY), ('all', INTERVAL 100000 DAY)) v(r, i) WHERE ts >= last - i GROUP BY r
UNION ALL SELECT 'ytd', count(*) FROM events, l WHERE ts >= date_trunc('year', last)""")
def f22(spark, sf):
    events = table(spark, sf, "events")
    last = events.agg(F.max("ts").alias("last"))
    rows = events.crossJoin(F.broadcast(last))
    within = {"day": 1, "week": 7, "month": 30, "all": 100000}
    names = [F.when(F.col("ts") >= F.col("last") - F.expr(f"INTERVAL {d} DAYS"), F.lit(n)) for n, d in within.items()]
    names.append(F.when(F.col("ts") >= F.date_trunc("year", F.col("last")), F.lit("ytd")))
    return rows.select(F.explode(F.array_compact(F.array(*names))).alias("range_name")).groupBy("range_name").agg(F.count("*").alias("n"))


@query("f23_checks", """SELECT 'candidates.years' AS rule, count(*) FILTER (WHERE NOT years_of_experience >= 0) AS violations FROM candidates
UNION ALL SELECT 'jobs.status', count(*) FILTER (WHERE status NOT IN ('DRAFT', 'OPEN', 'PAUSED', 'CLOSED')) FROM jobs
UNION ALL SELECT 'applications.stage', count(*) FILTER (WHERE stage NOT IN ('Applied', 'Screened', 'Interview', 'Offer')) FROM applications
UNION ALL SELECT 'applications.score', count(*) FILTER (WHERE NOT score BETWEEN 0 AND 100) FROM applications
UNION ALL SELECT 'applications.pair', count(*) - count(DISTINCT (candidate_id, job_id)) FROM applications""", ("candidates", "jobs", "applications"))
def f23(spark, sf):
    def rule(name: str, df, bad):
        return df.agg(F.count_if(bad).alias("violations")).select(F.lit(name).alias("rule"), "violations")

    applications = entity(spark, sf, "applications")
    pairs = applications.groupBy("candidate_id", "job_id").agg((F.count("*") - 1).alias("extra")).agg(F.sum("extra").alias("violations"))
    return (
        rule("candidates.years", entity(spark, sf, "candidates"), ~(F.col("years_of_experience") >= 0))
        .unionByName(rule("jobs.status", entity(spark, sf, "jobs"), ~F.col("status").isin("DRAFT", "OPEN", "PAUSED", "CLOSED")))
        .unionByName(rule("applications.stage", applications, ~F.col("stage").isin("Applied", "Screened", "Interview", "Offer")))
        .unionByName(rule("applications.score", applications, ~F.col("score").between(0, 100)))
        .unionByName(pairs.select(F.lit("applications.pair").alias("rule"), "violations"))
    )


@query("f24_status_regex", "SELECT id, status, regexp_matches(status, '^(OPEN|PAUSED|CLOSED)$') AS accepted FROM jobs", J)
def f24(spark, sf):
    return entity(spark, sf, "jobs").select("id", "status", F.col("status").rlike("^(OPEN|PAUSED|CLOSED)$").alias("accepted"))


@query("f25_pdf_drop", "SELECT page_id, url LIKE '%.pdf' OR page_id % 3 = 0 AS accepted FROM pages")
def f25(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, "application/pdf").otherwise("text/html")
    return table(spark, sf, "pages").withColumn("type", kind).select("page_id", ((F.col("type") == "application/pdf") | F.col("url").endswith(".pdf")).alias("accepted"))
