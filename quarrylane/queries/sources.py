"""Sources, scans and sinks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarrylane.functions import numeric, text
from quarrylane.operators import layout
from quarrylane.operators.audits import append_audit, audit_rows
from quarrylane.queries.aggregates import FUNNEL, hiring_funnel
from quarrylane.registry import query
from quarrylane.session import shared_dir
from quarrylane.sources import files, schemas
from quarrylane.sources.entities import entity, table


A, C, J, U = ("applications",), ("candidates",), ("jobs",), ("audits",)
HTML = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("src01_scan_pdf_text", f"SELECT page_id, {HTML} AS text FROM pages WHERE {HTML} <> ''")
def src01(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_text(F.col("html")).alias("text")).where("text <> ''")


@query("src02_scan_pdf_blocks", """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS no, CAST(l_suppkey AS DOUBLE) AS y0, l_quantity AS x0, CASE WHEN l_linenumber % 5 = 0 THEN '  ' ELSE concat(' ', l_returnflag, l_partkey, ' ') END AS t, CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END AS k FROM lineitem)
SELECT page, string_agg(trim(t), chr(10) || chr(10) ORDER BY y0, x0, trim(t)) FILTER (WHERE k = 0 AND trim(t) <> '') AS text FROM b GROUP BY page HAVING count(*) FILTER (WHERE k = 0 AND trim(t) <> '') > 0""")
def src02(spark, sf):
    words = F.when(F.col("l_linenumber") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "l_returnflag", F.col("l_partkey").cast("string"), F.lit(" ")))
    block = F.struct(F.col("l_suppkey").cast("double").alias("y0"), F.col("l_quantity").alias("x0"), words.alias("text"), F.when(F.col("l_tax") > 0.06, 1).otherwise(0).alias("type"))
    pages = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(block).alias("blocks"))  # the few blocks of one page
    return pages.select("page", layout.reading_order(F.col("blocks")).alias("text")).where("text <> ''")


@query("src03_scan_pdf_deep", r"""SELECT page_id, '# ' || regexp_extract(html, '(?is)<title>(.*?)</title>', 1) || chr(10) || chr(10) ||
trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS markdown FROM pages""")
def src03(spark, sf):
    """Titles and paragraphs of pages as Markdown, by the stand-in decoder."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("# "), title, F.lit("\n\n"), text.html_text(F.col("html"))).alias("markdown"))


@query("src04_route_parser", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 7 = 0 THEN 'simple_fallback' WHEN doc_id % 3 = 0 THEN 'deep' WHEN length(trim(text)) < 50 AND doc_id % 7 <> 0 THEN 'deep' ELSE 'simple' END AS engine FROM documents""")
def src04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", layout.parser(F.col("doc_id") % 3 == 0, F.col("text"), F.col("doc_id") % 7 == 0).alias("engine"))


@query("src05_accept_upload", "SELECT page_id, page_id % 4 < 3 OR lower(concat(url, CASE WHEN page_id % 2 = 0 THEN '.PDF' ELSE '' END)) LIKE '%.pdf' AS accepted FROM pages")
def src05(spark, sf):
    mime = F.element_at(F.array(*map(F.lit, ("application/pdf", "application/x-pdf", "application/octet-stream", "text/plain"))), (F.col("page_id") % 4 + 1).cast("int"))
    name = F.concat("url", F.when(F.col("page_id") % 2 == 0, ".PDF").otherwise(""))
    return table(spark, sf, "pages").select("page_id", layout.accepted(mime, name).alias("accepted"))


@query("src06_stage_file", "SELECT count(*) AS files, 0::BIGINT AS empty FROM pages")
def src06(spark, sf):
    """Pages staged as files by Spark and read back by the file stream until none is left."""
    folder = shared_dir(spark)
    table(spark, sf, "pages").select(F.regexp_replace("html", r"\s+", " ").alias("value")).repartition(4).write.text(f"{folder}/in")
    out = f"{folder}/out"
    lines = spark.readStream.schema("value string").text(f"{folder}/in")
    lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("value string").parquet(out).agg(F.count("*").alias("files"), F.count_if(F.col("value") == "").alias("empty"))


@query("src07_scan_pg", "SELECT id, name, round(balance, 2) AS score FROM candidates", C)
def src07(spark, sf):
    return entity(spark, sf, "candidates").select("id", "name", F.round("balance", 2).alias("score"))


@query("src08_scan_store", "SELECT id, title, department, status, skills_csv FROM jobs", J)
def src08(spark, sf):
    return entity(spark, sf, "jobs").select("id", "title", "department", "status", F.array_join("skills", ",").alias("skills_csv"))


@query("src09_insert_candidate", "SELECT id, coalesce(highest_education, 'Not Specified') AS highest_education, location, '[CANDIDATE_NAME]' AS anonymized_name, 'hybrid' AS parsing_engine FROM candidates", C)
def src09(spark, sf):
    path = shared_dir(spark)
    rows = files.with_defaults(entity(spark, sf, "candidates"), {"highest_education": "Not Specified", "location": "Remote", "anonymized_name": "[CANDIDATE_NAME]", "parsing_engine": "hybrid"})
    rows = rows.select("id", "highest_education", "location", "anonymized_name", "parsing_engine")
    files.append(rows.where("id % 2 = 0"), path)
    files.append(rows.where("id % 2 = 1"), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("src11_append_audit", "SELECT id, CASE WHEN score >= 80 THEN 'Strong Fit' WHEN score >= 60 THEN 'Potential Fit' ELSE 'Low Match' END AS qualification_tier, concat('Why ', stage, '?') AS question, CAST(year(applied_at) AS BIGINT) AS year FROM applications", A)
def src11(spark, sf):
    path = shared_dir(spark)
    ask = F.array(F.struct(F.concat(F.lit("Why "), "stage", F.lit("?")).alias("question")))
    reports = entity(spark, sf, "applications").select("id", F.col("score").alias("overall_match_score"), ask.alias("suggested_interview_questions"), F.year("applied_at").alias("evaluated_on"))
    append_audit(audit_rows(reports), path)
    return spark.read.parquet(path).select("id", "qualification_tier", F.get("recommended_interview_questions", F.lit(0)).alias("question"), F.col("evaluated_on").cast("long").alias("year"))


PROVISIONED = {"candidates": "candidates", "job_postings": "jobs", "applications": "applications", "scoring_audits": "audits"}


@query("src12_provision", " UNION ALL ".join(f"SELECT '{name}' AS table_name, {len(schemas.TABLES_DDL[name].split(', '))} AS columns, (SELECT count(*) FROM {own}) AS rows" for name, own in PROVISIONED.items()), tuple(PROVISIONED.values()))
def src12(spark, sf):
    """Empty tables by the schemas, each read beside the rows that are there for it."""
    out = None
    for name, own in PROVISIONED.items():
        path = shared_dir(spark)
        spark.createDataFrame([], schemas.table_schema(name)).write.parquet(path)
        columns = len(spark.read.parquet(path).columns)
        row = entity(spark, sf, own).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), F.lit(columns).alias("columns"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("src13_queue_source", "SELECT event_type, count(*) AS n, sum(value) IS NOT NULL AS has_value FROM events GROUP BY event_type")
def src13(spark, sf):
    """Events as messages through a stream, counted as they come."""
    events = table(spark, sf, "events")
    folder = shared_dir(spark)
    events.select(F.to_json(F.struct("event_type", "value")).alias("value")).write.text(f"{folder}/queue")
    out = f"{folder}/out"
    messages = spark.readStream.schema("value string").text(f"{folder}/queue")
    parsed = messages.select(F.from_json("value", "event_type string, value double").alias("m")).select("m.*")
    parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_type string, value double").parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").isNotNull().alias("has_value"))


@query("src14_export_csv", f"WITH {FUNNEL} SELECT stage AS \"Stage\", n AS \"Count\", round(n * 100.0 / lag(n) OVER (ORDER BY stage_no), 2) AS \"Conversion Rate\" FROM f", A)
def src14(spark, sf):
    path = shared_dir(spark)
    files.export_csv(hiring_funnel(entity(spark, sf, "applications")), path, {"stage": "Stage", "n": "Count", "conversion": "Conversion Rate"})
    return spark.read.option("header", True).schema("`Stage` string, `Count` long, `Conversion Rate` double").csv(path)


@query("src15_json_api", """SELECT concat('{"id":', id, ',"stage":"', stage, '","status":"', status, '"}') AS body FROM applications""", A)
def src15(spark, sf):
    return files.as_json(entity(spark, sf, "applications").select("id", "stage", "status"))


@query("src16_synth_corpus")
def src16(spark, sf):
    """A seeded retrieval corpus in the size of the documents table: domain, skills and text of each."""
    skills = ["Python", "Go", "Kafka", "PostgreSQL", "Docker", "AWS", "React"]
    pick = lambda k: F.element_at(F.array(*map(F.lit, skills)), (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(len(skills))) + 1).cast("int"))
    domain = F.element_at(F.array(*map(F.lit, ("backend", "data", "frontend", "cloud", "security"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf, "documents").select(F.format_string("cand_%04d", "doc_id").alias("id"), domain.alias("domain"), pick(1).alias("a"), pick(2).alias("b"), (F.pmod(F.xxhash64("doc_id"), F.lit(13)) + 2).alias("years"))
    return rows.select("id", "domain", F.array_join(F.array_distinct(F.array("a", "b")), ",").alias("skills"), F.concat(F.lit("Candidate "), "id", F.lit(" - "), "domain", F.lit(" Specialist with "), F.col("years").cast("string"), F.lit(" years experience. Core Technical Competencies: "), "a", F.lit(", "), "b", F.lit(".")).alias("text"))


@query("src17_synth_pii", """WITH r AS (SELECT c_custkey AS resume_id, c_name, concat('user', c_custkey, '@mail.example.com') AS email FROM customer)
SELECT resume_id, concat(c_name, chr(10), email) AS raw_text, 'name' AS pii_type, c_name AS pii_value FROM r UNION ALL SELECT resume_id, concat(c_name, chr(10), email), 'email', email FROM r""")
def src17(spark, sf):
    """Résumés with the personal data that was put in, as pairs to look for."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("resume_id"), F.col("c_name").alias("name"), F.format_string("user%d@mail.example.com", "c_custkey").alias("email"))
    return rows.select("resume_id", F.concat("name", F.lit("\n"), "email").alias("raw_text"), F.explode(F.create_map(F.lit("name"), "name", F.lit("email"), "email")).alias("pii_type", "pii_value"))


@query("src18_synth_vectors")
def src18(spark, sf):
    """A seeded unit vector for each candidate: its length and first component."""
    rng = random.Random(7)
    seeds = [rng.randrange(1 << 31) for _ in range(16)]
    raw = F.array(*[F.pmod(F.xxhash64("id", F.lit(s)), F.lit(2001)).cast("double") / 1000 - 1 for s in seeds])
    rows = entity(spark, sf, "candidates").select("id", raw.alias("raw"))
    unit = F.transform("raw", lambda x: x / F.col("n"))
    return rows.withColumn("n", numeric.norm(F.col("raw"))).withColumn("v", unit).select("id", F.round(numeric.norm(F.col("v")), 9).alias("length"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("src20_probe_model", "SELECT CASE WHEN count(*) > 0 THEN 'rules' END AS backend, count(*) AS rows_ready FROM candidates", C)
def src20(spark, sf):
    """Which evaluator serves: a model where the session names one, else the rules."""
    backend = spark.conf.get("quarrylane.model.endpoint", "") and "model" or "rules"
    return entity(spark, sf, "candidates").agg(F.count("*").alias("rows_ready")).select(F.lit(backend).alias("backend"), "rows_ready")



