"""Normalising model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylane.functions import coercion
from quarrylane.operators.audits import audit_rows
from quarrylane.registry import query
from quarrylane.sources import schemas
from quarrylane.sources.entities import entity, table

L, C, A = ("llm_json",), ("candidates",), ("applications",)


def docs(spark, sf):
    return entity(spark, sf, "llm_json")


def field(name: str):
    return F.get_json_object("doc", f"$.{name}")


def duck_alias(name: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(doc, '$.{k}')" for k in coercion.ALIASES[name]) + ")"


def duck_category(value: str, rules) -> str:
    names = ", ".join(f"'{n}'" for _, n in rules)
    cases = " ".join("WHEN " + (" OR ".join(f"contains(lower({value}), '{w}')" for w in words) or "true") + f" THEN '{n}'" for words, n in rules)
    return f"CASE WHEN {value} IS NULL OR {value} = '' THEN {value} WHEN {value} IN ({names}) THEN {value} {cases} END"


@query("c01_alias_coalesce", f"SELECT id, {duck_alias('company_name')} AS company_name, coalesce({duck_alias('job_title')}, 'Engineer') AS job_title, {duck_alias('end_date')} AS end_date FROM llm_json", L)
def c01(spark, sf):
    return docs(spark, sf).select("id", coercion.alias(F.col("doc"), "company_name").alias("company_name"), F.coalesce(coercion.alias(F.col("doc"), "job_title"), F.lit("Engineer")).alias("job_title"), coercion.alias(F.col("doc"), "end_date").alias("end_date"))


@query("c02_to_string_dates", f"SELECT id, {duck_alias('graduation_year')} AS graduation_year FROM llm_json", L)
def c02(spark, sf):
    return docs(spark, sf).select("id", coercion.alias(F.col("doc"), "graduation_year").alias("graduation_year"))


@query("c03_skill_shape", f"SELECT id, CASE WHEN json_extract_string(doc, '$.cat') IN ('Cloud & DevOps', 'Soft Skill') THEN json_extract_string(doc, '$.cat') ELSE 'Tooling & Platforms' END AS category, {duck_category(duck_alias('proficiency'), coercion.PROFICIENCY)} AS proficiency FROM llm_json", L)
def c03(spark, sf):
    return docs(spark, sf).select("id", coercion.skill_category(field("cat")).alias("category"), coercion.category(coercion.alias(F.col("doc"), "proficiency"), coercion.PROFICIENCY).alias("proficiency"))


@query("c04_taxonomy_shape", "SELECT id, 'Tooling & Platforms' AS category, unnest(string_split(skills_csv, ',')) AS name FROM candidates", C)
def c04(spark, sf):
    # Half come as a list of names, half as an object of lists under keys that aren't known; both become one list.
    rows = entity(spark, sf, "candidates").withColumn("doc", F.when(F.col("id") % 2 == 0, F.to_json("skills")).otherwise(F.to_json(F.struct(F.col("skills").alias("my_tools")))))
    listed = F.from_json("doc", "array<string>")
    keyed = F.flatten(F.map_values(F.from_json("doc", "map<string,array<string>>")))
    return rows.select("id", F.lit("Tooling & Platforms").alias("category"), F.explode(F.when(F.col("doc").startswith("["), listed).otherwise(keyed)).alias("name"))


@query("c05_workplace_map", f"""SELECT id, {duck_category("json_extract_string(doc, '$.place')", coercion.WORKPLACE)} AS workplace_type FROM llm_json""", L)
def c05(spark, sf):
    return docs(spark, sf).select("id", coercion.category(field("place"), coercion.WORKPLACE).alias("workplace_type"))


@query("c06_timeline_shape", "SELECT id, id % 2 = 0 AS wrapped, CAST(len(string_split(skills_csv, ',')) AS BIGINT) AS positions, 0.0 AS total_years FROM candidates", C)
def c06(spark, sf):
    jobs = F.to_json(F.transform("skills", lambda s: F.struct(s.alias("title"))))
    raw = F.when(F.col("id") % 2 == 0, jobs).otherwise(F.concat(F.lit('{"positions": '), jobs, F.lit("}")))
    rows = entity(spark, sf, "candidates").withColumn("raw", raw).withColumn("doc", coercion.as_list(F.col("raw"), "positions"))
    parsed = F.from_json("doc", "positions array<struct<title:string>>, total_continuous_years double")
    return rows.select("id", (F.col("raw") != F.col("doc")).alias("wrapped"), F.size(parsed["positions"]).cast("long").alias("positions"), F.coalesce(parsed["total_continuous_years"], F.lit(0.0)).alias("total_years"))


@query("c07_criterion_map", f"""SELECT id, {duck_category("json_extract_string(doc, '$.cat')", coercion.CRITERION)} AS criterion FROM llm_json""", L)
def c07(spark, sf):
    return docs(spark, sf).select("id", coercion.category(field("cat"), coercion.CRITERION).alias("criterion"))


@query("c08_question_map", f"""SELECT id, {duck_category("json_extract_string(doc, '$.question')", coercion.QUESTION)} AS category FROM llm_json""", L)
def c08(spark, sf):
    return docs(spark, sf).select("id", coercion.category(field("question"), coercion.QUESTION).alias("category"))


@query("c09_tier_map", f"""SELECT id, {duck_category("json_extract_string(doc, '$.tier')", coercion.TIER)} AS tier FROM llm_json""", L)
def c09(spark, sf):
    return docs(spark, sf).select("id", coercion.category(field("tier"), coercion.TIER).alias("tier"))


@query("c10_uuid_normalise", f"""WITH h AS (SELECT id, CASE WHEN id % 9 > 0 THEN sha1(from_hex('{coercion.DNS}') || encode(concat('cand-', id))) END AS h FROM candidates)
SELECT id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', ('89ab')[CAST(concat('0x', h[17]) AS INTEGER) % 4 + 1], h[18:20], '-', h[21:32]) AS uuid FROM h WHERE h IS NOT NULL UNION ALL SELECT id, NULL FROM h WHERE h IS NULL""", C)
def c10(spark, sf):
    return entity(spark, sf, "candidates").select("id", coercion.stable_uuid(F.when(F.col("id") % 9 > 0, F.concat(F.lit("cand-"), F.col("id").cast("string")))).alias("uuid"))


@query("c11_dump_json", """SELECT id, concat('{"id":', id, ',"stage":"', stage, '","stage_no":', stage_no, '}') AS doc FROM applications""", A)
def c11(spark, sf):
    return entity(spark, sf, "applications").select("id", F.to_json(F.struct("id", "stage", "stage_no")).alias("doc"))


@query("c12_json_schema")
def c12(spark, sf):
    """The profile's schema, with how many résumés there are to fill it."""
    n = entity(spark, sf, "resumes").agg(F.count("*").alias("resumes"))
    return n.select(F.lit(schemas.profile().json()).alias("schema"), "resumes")


@query("c13_struct_merge", "SELECT id, stage, round(score / 100, 4) AS score, stage_no + 1 AS rank FROM applications", A)
def c13(spark, sf):
    rows = entity(spark, sf, "applications").select(F.struct("id", "stage", "stage_no").alias("cand"), "score")
    merged = F.col("cand").withField("score", F.round(F.col("score") / 100, 4)).withField("rank", F.col("cand.stage_no") + 1)
    return rows.select(merged.alias("m")).select("m.id", "m.stage", "m.score", "m.rank")


@query("c14_array_any", "SELECT id, list_contains(string_split(skills_csv, ','), 'Kafka') AS has_kafka, array_to_string(string_split(skills_csv, ',')[1:3], ', ') AS first_three FROM candidates", C)
def c14(spark, sf):
    return entity(spark, sf, "candidates").select("id", F.exists("skills", lambda s: s == "Kafka").alias("has_kafka"), F.array_join(F.slice("skills", 1, 3), ", ").alias("first_three"))


@query("c15_citation_unnest", "SELECT id, unnest(string_split(concat(stage, '|', status), '|')) AS citation, unnest([0, 1]) AS pos FROM applications", A)
def c15(spark, sf):
    return entity(spark, sf, "applications").select("id", F.posexplode_outer(F.array("stage", "status")).alias("pos", "citation"))


@query("c16_audit_twin", "SELECT id, concat('Good at ', stage) AS pros, score AS match_score FROM applications", A)
def c16(spark, sf):
    """A deep report under the short report's names."""
    ask = F.array(F.struct(F.lit("Why?").alias("question")))
    deep = entity(spark, sf, "applications").select("id", F.col("score").alias("overall_match_score"), F.array(F.concat(F.lit("Good at "), "stage")).alias("key_strengths"), ask.alias("suggested_interview_questions"))
    return audit_rows(deep).select("id", F.array_join("key_strengths", ";").alias("pros"), F.col("overall_match_score").alias("match_score"))


@query("c17_events_variant", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def c17(spark, sf):
    return table(spark, sf, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))
