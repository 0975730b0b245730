"""The engine's entities over the given tables, in SQL that Spark and the oracle both read.

These are views, not operators: they only give the tables the shape of candidates, jobs, applications and so on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL = {
    "candidates": """
SELECT c_custkey AS id, c_name AS name,
  CASE c_custkey % 5 WHEN 0 THEN 'Senior Backend Engineer' WHEN 1 THEN 'Data Scientist' WHEN 2 THEN 'Product Designer'
    WHEN 3 THEN 'Staff Platform Architect' ELSE 'Account Executive' END AS target_headline,
  CAST(c_custkey * 7 % 160 AS DOUBLE) / 10 AS years_of_experience,
  CASE WHEN c_custkey % 7 = 0 THEN 'Remote' ELSE concat(n_name, ', ', r_name) END AS location,
  CASE c_custkey % 6 WHEN 0 THEN 'Master of Science' WHEN 1 THEN 'Bachelor of Science' WHEN 2 THEN 'PhD in Computing'
    WHEN 3 THEN NULL WHEN 4 THEN 'Master of Engineering' ELSE 'Diploma' END AS highest_education,
  concat(CASE c_custkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' ELSE 'Java' END, ',',
    CASE c_custkey % 4 WHEN 0 THEN 'Docker' WHEN 1 THEN 'Kubernetes' WHEN 2 THEN 'PostgreSQL' ELSE 'Kafka' END, ',',
    CASE c_custkey % 5 WHEN 0 THEN 'AWS' WHEN 1 THEN 'React' WHEN 2 THEN 'Figma' WHEN 3 THEN 'Terraform' ELSE 'Salesforce' END,
    CASE WHEN c_custkey % 2 = 0 THEN ',Git' ELSE '' END) AS skills_csv,
  CASE c_custkey % 4 WHEN 0 THEN 'Contacted' WHEN 1 THEN 'Screened' WHEN 2 THEN 'Interview' ELSE 'Offer' END AS stage,
  CASE c_custkey % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Passive' ELSE 'Placed' END AS status,
  c_mktsegment AS source, c_acctbal AS balance
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "jobs": """
SELECT p_partkey AS id, concat(p_type, ' ', p_name) AS title,
  CASE p_partkey % 5 WHEN 0 THEN 'Data Platform' WHEN 1 THEN 'Product' WHEN 2 THEN 'Design Studio' WHEN 3 THEN 'Engineering' ELSE 'Sales' END AS department,
  CASE p_partkey % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Austin, TX' ELSE 'Berlin, Germany' END AS location,
  CASE p_partkey % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'PAUSED' WHEN 2 THEN 'CLOSED' ELSE 'DRAFT' END AS status,
  CAST(p_size AS DOUBLE) / 5 AS min_years_experience,
  concat(CASE p_partkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' ELSE 'Java' END, ',', CASE p_partkey % 4 WHEN 0 THEN 'Docker' WHEN 1 THEN 'Kubernetes' WHEN 2 THEN 'PostgreSQL' ELSE 'Kafka' END) AS skills_csv,
  concat('We need ', p_name, CASE p_partkey % 4 WHEN 0 THEN ' with python and aws' WHEN 1 THEN ' using TypeScript, React' WHEN 2 THEN ' on kubernetes' ELSE '' END) AS job_description,
  p_brand AS brand, p_retailprice AS budget, p_partkey % 2 = 0 AS run_ai_match
FROM {part}""",
    "applications": """
SELECT o_orderkey AS id, o_custkey AS candidate_id, o_orderkey % 200 AS job_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Hired' WHEN '2-HIGH' THEN 'Offer' WHEN '3-MEDIUM' THEN 'Interview' WHEN '4-NOT SPECIFIED' THEN 'Screened' ELSE 'Applied' END AS stage,
  CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 1 END AS stage_no,
  o_orderstatus AS status, o_orderdate AS applied_at, CAST(o_orderkey * 37 % 1001 AS DOUBLE) / 10 AS score
FROM {orders}""",
    "audits": """
SELECT l_orderkey AS application_id, l_linenumber AS attempt, l_partkey AS job_id, l_suppkey AS reviewer_id, l_returnflag AS model, l_linestatus AS tier,
  CAST(l_quantity AS BIGINT) * 50 AS prompt_tokens, CAST(l_quantity AS BIGINT) * 11 AS completion_tokens,
  CAST(floor(l_extendedprice / 10) AS BIGINT) AS latency_ms, l_shipdate AS evaluated_at
FROM {lineitem}""",
    "resumes": """
SELECT c_custkey AS id, concat(
  CASE WHEN c_custkey % 11 = 0 THEN 'Curriculum Vitae' ELSE c_name END, chr(10),
  CASE c_custkey % 5 WHEN 0 THEN 'Senior Software Engineer' WHEN 1 THEN 'Data Scientist' WHEN 2 THEN 'Gardener' WHEN 3 THEN 'Staff Platform Architect' ELSE 'Account Manager' END, chr(10),
  '  ', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('user', c_custkey, '@mail', c_custkey % 9, '.example.com') END, '  ', chr(10), chr(10),
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('+1-555-', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END, chr(10),
  CASE WHEN c_custkey % 5 = 1 THEN concat('https://www.linkedin.com/in/user-', c_custkey) ELSE '' END, chr(10),
  CASE c_custkey % 4 WHEN 0 THEN 'Austin, TX 78701' WHEN 1 THEN 'Munich, Germany' WHEN 2 THEN 'Some University, CA' ELSE '' END, chr(10),
  CASE c_custkey % 3 WHEN 0 THEN 'Master of Science in Computing' WHEN 1 THEN 'studied at Stanford for years' ELSE '' END, chr(10),
  'Experience with ', CASE c_custkey % 4 WHEN 0 THEN 'Python, Docker and AWS' WHEN 1 THEN 'React and TypeScript' WHEN 2 THEN 'nothing to name' ELSE 'Kafka, Go, SQL, Rust, Redis, Linux' END, chr(10),
  CASE WHEN c_custkey % 6 = 5 THEN '' ELSE concat(CAST(1985 + c_custkey % 40 AS STRING), ' - ', CASE WHEN c_custkey % 2 = 0 THEN 'Present' ELSE '2024' END) END, chr(10),
  'Acme Systems Inc') AS raw_text
FROM {customer}""",
    "llm_json": """
SELECT event_id AS id, concat('{{', CASE event_id % 4 WHEN 0 THEN '"company_name": "Acme"' WHEN 1 THEN '"employer": "Beta"' WHEN 2 THEN '"organization": "Gamma"' ELSE '"company": "Delta"' END,
  CASE event_id % 3 WHEN 0 THEN ', "title": "Lead"' WHEN 1 THEN ', "role": "Dev"' ELSE '' END,
  ', "year": ', CAST(1990 + event_id % 35 AS STRING),
  CASE event_id % 5 WHEN 0 THEN ', "score": "4.5"' WHEN 1 THEN ', "score": "4"' WHEN 2 THEN ', "score": 9' WHEN 3 THEN ', "score": 0' ELSE '' END,
  CASE event_id % 7 WHEN 0 THEN ', "overall": "n/a"' WHEN 1 THEN ', "overall": 140.5' WHEN 2 THEN ', "overall": -3' ELSE ', "overall": 71.25' END,
  ', "cat": "', CASE event_id % 6 WHEN 0 THEN 'Technical skills' WHEN 1 THEN 'Seniority' WHEN 2 THEN 'System design' WHEN 3 THEN 'Metrics and impact' WHEN 4 THEN 'Industry knowledge' ELSE 'Other' END,
  '", "tier": "', CASE event_id % 5 WHEN 0 THEN 'STRONG yes' WHEN 1 THEN 'reject' WHEN 2 THEN 'Strong Fit' WHEN 3 THEN 'poor' ELSE 'maybe' END,
  '", "place": "', CASE event_id % 5 WHEN 0 THEN 'fully remote' WHEN 1 THEN 'HYBRID 3 days' WHEN 2 THEN 'in office' WHEN 3 THEN 'On-site' ELSE 'moon' END,
  '", "level": "', CASE event_id % 6 WHEN 0 THEN 'expert' WHEN 1 THEN 'Sr. dev' WHEN 2 THEN 'junior' WHEN 3 THEN 'Advanced' WHEN 4 THEN 'so so' ELSE 'beginner' END,
  '", "question": "', CASE event_id % 5 WHEN 0 THEN 'coding' WHEN 1 THEN 'System thinking' WHEN 2 THEN 'risk check' WHEN 3 THEN 'leadership' ELSE 'misc' END, '"}}') AS doc, event_type, user_id, ts
FROM {events}""",
}


def duck(name: str) -> str:
    """The entity's SQL for the oracle, over its views."""
    return SQL[name].format(**{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An entity; where it has skills, `skills` is their array."""
    needed = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\{{{t}\}}", SQL[name])}
    df = spark.sql(SQL[name], **needed)
    return df.withColumn("skills", F.split("skills_csv", ",")) if "skills_csv" in df.columns else df
