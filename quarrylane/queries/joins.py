"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylane.functions import text
from quarrylane.operators.layout import overlapping_blocks
from quarrylane.operators.mutations import skills_or_keywords
from quarrylane.plans.retrieval import dense_scores, fuse, overlap_of_terms, tiled_pairs
from quarrylane.plans.text_search import catalogue_matches
from quarrylane.registry import query
from quarrylane.session import carried
from quarrylane.session import table as written
from quarrylane.sources.entities import entity, table

C, J, A = ("candidates",), ("jobs",), ("applications",)
#: In the oracle: text for the token pattern, whose word boundaries there know ASCII alone.
ASCII = r"regexp_replace(lower({0}), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{M}}\p{{C}}]', '_', 'g')"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def duck_tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all({ASCII.format(column)}, '{text.TOKEN}'), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


def ranked(spark, sf):
    """Two ranked channels over applications, for one query each job."""
    rows = entity(spark, sf, "applications")
    a = rows.where("id % 3 < 2").select(F.col("job_id").alias("query_id"), F.col("candidate_id").alias("doc_id"), F.col("stage_no").cast("long").alias("rank"))
    b = rows.where("id % 3 > 0").select(F.col("job_id").alias("query_id"), F.col("candidate_id").alias("doc_id"), (F.col("id") % 50 + 1).alias("rank"))
    return a.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")), b.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))


CHANNELS = """a AS (SELECT job_id AS query_id, candidate_id AS doc_id, min(stage_no) AS rank FROM applications WHERE id % 3 < 2 GROUP BY 1, 2),
b AS (SELECT job_id AS query_id, candidate_id AS doc_id, min(id % 50 + 1) AS rank FROM applications WHERE id % 3 > 0 GROUP BY 1, 2)"""


@query("j01_rrf_merge", f"""WITH {CHANNELS} SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank::BIGINT AS dense_rank, b.rank::BIGINT AS bm25_rank,
round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 6) AS rrf FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id""", A)
def j01(spark, sf):
    a, b = ranked(spark, sf)
    return fuse({"dense": a, "bm25": b}).withColumn("rrf", F.round("rrf", 6))


@query("j02_attach_metadata", "SELECT a.id, a.candidate_id, coalesce(c.target_headline, '{}') AS metadata FROM applications a LEFT JOIN candidates c ON c.id = a.candidate_id + 100", ("applications", "candidates"))
def j02(spark, sf):
    who = entity(spark, sf, "candidates").select((F.col("id") - 100).alias("candidate_id"), "target_headline")
    rows = entity(spark, sf, "applications").join(who, "candidate_id", "left")
    return rows.select("id", "candidate_id", F.coalesce("target_headline", F.lit("{}")).alias("metadata"))


@query("j03_query_x_docs", """SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0""")
def j03(spark, sf):
    """The stated query set against all vectors, in blocks of queries."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense_scores(rows, asked).select("query_id", "doc_id", (F.round("score", 6) + 0.0).alias("score"))


@query("j04_term_postings", f"""WITH q AS (SELECT item_id, unnest(list_distinct({duck_tokens('text')})) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({duck_tokens('text')}) AS term FROM documents) GROUP BY 1, 2)
SELECT item_id, term, count(*) AS docs, sum(tf)::BIGINT AS tf FROM q JOIN p USING (term) GROUP BY 1, 2""")
def j04(spark, sf):
    q = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    p = table(spark, sf, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return q.join(p, "term").groupBy("item_id", "term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


BLOCKS = """blocks AS (SELECT l_orderkey AS page, l_linenumber AS no, CASE WHEN l_partkey % 2 = 0 THEN 10.0 ELSE 310.0 END AS x0, CAST(l_suppkey % 20 AS DOUBLE) * 10 AS y0,
CASE WHEN l_partkey % 2 = 0 THEN 290.0 ELSE 590.0 END AS x1, CAST(l_suppkey % 20 AS DOUBLE) * 10 + l_quantity AS y1 FROM lineitem)"""


def blocks(spark, sf):
    rows = table(spark, sf, "lineitem")
    left = F.col("l_partkey") % 2 == 0
    top = (F.col("l_suppkey") % 20).cast("double") * 10
    return rows.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("no"), F.when(left, 10.0).otherwise(310.0).alias("x0"), top.alias("y0"),
        F.when(left, 290.0).otherwise(590.0).alias("x1"), (top + F.col("l_quantity")).alias("y1"),
    )


@query("j05_block_overlap", f"""WITH {BLOCKS} SELECT l.page, count(*) AS overlaps FROM blocks l JOIN blocks r ON l.page = r.page AND l.x1 <= 315 AND r.x1 > 315 AND r.x0 >= 285
AND greatest(l.y0, r.y0) < least(l.y1, r.y1) GROUP BY l.page HAVING count(*) >= 2""")
def j05(spark, sf):
    return overlapping_blocks(blocks(spark, sf), F.lit(600.0)).groupBy("page").agg(F.count("*").alias("overlaps")).where("overlaps >= 2")


@query("j06_rerank_pairs", f"""WITH q AS (SELECT item_id, list_distinct({duck_tokens('text')}) AS qt FROM benchmark), p AS (SELECT conv_id, turn, list_distinct({duck_tokens('text')}) AS pt FROM conversations)
SELECT item_id, conv_id, turn, round(CASE WHEN len(qt) = 0 THEN -4 ELSE len(list_intersect(qt, pt)) / len(qt) * 8.0 - 4.0 END, 6) AS logit FROM q, p""")
def j06(spark, sf):
    q = F.broadcast(table(spark, sf, "benchmark").select("item_id", F.array_distinct(text.tokens(F.col("text"))).alias("query")))
    p = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(text.tokens(F.col("text"))).alias("passage"))
    return p.crossJoin(q).select("item_id", "conv_id", "turn", F.round(overlap_of_terms(F.col("query"), F.col("passage")), 6).alias("logit"))


@query("j07_qrels_semi", "SELECT job_id, count(*) AS hits FROM applications WHERE (job_id, candidate_id) IN (SELECT job_id, candidate_id FROM applications WHERE score >= 80) GROUP BY job_id", A)
def j07(spark, sf):
    rows = entity(spark, sf, "applications")
    return rows.join(rows.where("score >= 80").select("job_id", "candidate_id"), ["job_id", "candidate_id"], "left_semi").groupBy("job_id").agg(F.count("*").alias("hits"))


@query("j08_live_anti", "SELECT id, name, 'live' AS origin FROM candidates WHERE status = 'Active' UNION ALL SELECT id, name, 'pool' FROM candidates p WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM candidates l WHERE l.status = 'Active' AND l.id = p.id)", C)
def j08(spark, sf):
    rows = entity(spark, sf, "candidates").select("id", "name", "status")
    live, pool = rows.where("status = 'Active'"), rows.where("id % 2 = 0")
    return live.select("id", "name", F.lit("live").alias("origin")).unionByName(pool.join(live.select("id"), "id", "left_anti").select("id", "name", F.lit("pool").alias("origin")))


@query("j09_pii_truth", rf"""WITH t AS (SELECT id, regexp_replace(raw_text, '{text.EMAIL}', '[EMAIL_ADDRESS]', 'g') AS clean FROM resumes),
v AS (SELECT c_custkey AS id, unnest([{{'k': 'name', 'x': c_name}}, {{'k': 'email', 'x': concat('user', c_custkey, '@')}}]) AS v FROM customer)
SELECT id, v.k AS kind, NOT contains(clean, v.x) AS masked FROM t JOIN v USING (id)""", ("resumes",))
def j09(spark, sf):
    clean = entity(spark, sf, "resumes").select("id", F.regexp_replace("raw_text", text.EMAIL, "[EMAIL_ADDRESS]").alias("clean"))
    truth = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.create_map(F.lit("name"), "c_name", F.lit("email"), F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@")))).alias("kind", "value"))
    return truth.join(clean, "id").select("id", "kind", (~F.col("clean").contains(F.col("value"))).alias("masked"))


def _duck_skills(column: str) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches({column}, '{text.skill_pattern(s)}') THEN '{s}' END" for s in text.SKILLS)
    return f"list_filter([{tests}], lambda s: s IS NOT NULL)"


DEFAULT_SKILLS = "[" + ", ".join(f"'{s}'" for s in text.NO_SKILLS) + "]"


@query("j10_skill_catalog", f"WITH f AS (SELECT id, {_duck_skills('raw_text')} AS s FROM resumes) SELECT id, array_to_string(CASE WHEN len(s) > 0 THEN s ELSE {DEFAULT_SKILLS} END, ',') AS skills FROM f", ("resumes",))
def j10(spark, sf):
    return entity(spark, sf, "resumes").select("id", F.array_join(text.skills(F.col("raw_text")), ",").alias("skills"))


@query("j10_catalogue_table", f"SELECT id, array_to_string({_duck_skills('raw_text')}, ',') AS skills FROM resumes", ("resumes",))
def j10_catalogue(spark, sf):
    """The catalogue as a table, which may have any number of entries."""
    catalogue = spark.createDataFrame([(s, i) for i, s in enumerate(text.SKILLS)], "entry string, place long")
    return catalogue_matches(entity(spark, sf, "resumes").select("id", "raw_text"), catalogue, "raw_text").select("id", F.array_join("found", ",").alias("skills"))


@query("j11_upsert_match", "SELECT s.id, s.stage, c.id IS NOT NULL AS found FROM (SELECT id * 2 AS id, stage FROM candidates) s LEFT JOIN candidates c ON c.id = s.id", C)
def j11(spark, sf):
    rows = entity(spark, sf, "candidates")
    asked = rows.select((F.col("id") * 2).alias("id"), "stage")
    return asked.join(rows.select("id", F.lit(True).alias("f")), "id", "left").select("id", "stage", F.col("f").isNotNull().alias("found"))


@query("j12_app_edges", """SELECT a.id, c.name, j.title, count(u.attempt) AS audits, coalesce(sum(u.prompt_tokens), 0)::BIGINT AS tokens FROM applications a JOIN candidates c ON c.id = a.candidate_id
JOIN jobs j ON j.id = a.job_id LEFT JOIN audits u ON u.application_id = a.id GROUP BY a.id, c.name, j.title""", ("applications", "candidates", "jobs", "audits"))
def j12(spark, sf):
    c = entity(spark, sf, "candidates").select(F.col("id").alias("candidate_id"), "name")
    j = entity(spark, sf, "jobs").select(F.col("id").alias("job_id"), "title")
    u = entity(spark, sf, "audits").groupBy(F.col("application_id").alias("id")).agg(F.count("attempt").alias("audits"), F.sum("prompt_tokens").alias("tokens"))
    rows = entity(spark, sf, "applications").select("id", "candidate_id", "job_id").join(c, "candidate_id").join(j, "job_id").join(u, "id", "left")
    return rows.select("id", "name", "title", F.coalesce("audits", F.lit(0)).alias("audits"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


@query("j13_relevance_rule", """SELECT j.id AS query_id, c.id AS doc_id FROM jobs j JOIN candidates c ON (j.id % 5) = (c.id % 5) WHERE j.id % 50 = 0
AND (list_contains(string_split(c.skills_csv, ','), 'Git') OR list_has_any(string_split(c.skills_csv, ','), string_split(j.skills_csv, ',')[1:3]))""", ("jobs", "candidates"))
def j13(spark, sf):
    """The rule is judged once for each two sets of skills that meet, not for each pair of rows; then rows meet by an equi join, in tiles."""
    j = entity(spark, sf, "jobs").where("id % 50 = 0").select(F.col("id").alias("query_id"), (F.col("id") % 5).alias("domain"), F.slice("skills", 1, 3).alias("wanted"))
    c = entity(spark, sf, "candidates").select(F.col("id").alias("doc_id"), (F.col("id") % 5).alias("domain"), "skills")
    met = c.select("domain", "skills").distinct().join(carried(j.select("domain", "wanted").distinct()), "domain")
    fit = met.where(F.array_contains("skills", "Git") | F.arrays_overlap("skills", "wanted"))
    sought = c.join(carried(written(fit)), ["domain", "skills"]).select("doc_id", "domain", "wanted")
    return tiled_pairs(sought, j, ["domain", "wanted"])


@query("j14_key_word_default", "WITH k AS (SELECT id, list_filter(['Python', 'FastAPI', 'PostgreSQL', 'Kubernetes', 'AWS', 'React', 'TypeScript', 'Docker'], lambda w: contains(lower(job_description), lower(w))) AS f FROM jobs) SELECT id, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE ['Python', 'FastAPI', 'PostgreSQL'] END, ',') AS skills FROM k", J)
def j14(spark, sf):
    none = F.array().cast("array<string>")
    return entity(spark, sf, "jobs").select("id", F.array_join(skills_or_keywords(none, F.col("job_description")), ",").alias("skills"))


@query("set01_channel_union", f"WITH {CHANNELS} SELECT query_id, doc_id FROM a UNION SELECT query_id, doc_id FROM b", A)
def set01(spark, sf):
    a, b = ranked(spark, sf)
    return a.select("query_id", "doc_id").union(b.select("query_id", "doc_id")).distinct()


@query("set02_hits_intersect", f"WITH {CHANNELS} SELECT query_id, doc_id FROM a INTERSECT SELECT query_id, doc_id FROM b", A)
def set02(spark, sf):
    a, b = ranked(spark, sf)
    return a.select("query_id", "doc_id").intersect(b.select("query_id", "doc_id"))


@query("set03_live_union", "SELECT stage, count(*) AS n FROM (SELECT id, stage FROM candidates WHERE status = 'Placed' UNION ALL SELECT id, stage FROM candidates WHERE id NOT IN (SELECT id FROM candidates WHERE status = 'Placed')) GROUP BY stage", C)
def set03(spark, sf):
    rows = entity(spark, sf, "candidates").select("id", "stage", "status")
    live = rows.where("status = 'Placed'")
    return live.unionByName(rows.join(live.select("id"), "id", "left_anti")).groupBy("stage").agg(F.count("*").alias("n"))


@query("set04_skill_dedupe", "SELECT c.id, array_to_string(list_concat(string_split(c.skills_csv, ','), list_filter(string_split(j.skills_csv, ','), lambda s: NOT list_contains(string_split(c.skills_csv, ','), s))), ',') AS skills FROM candidates c JOIN jobs j ON j.id = c.id", ("candidates", "jobs"))
def set04(spark, sf):
    j = entity(spark, sf, "jobs").select("id", F.col("skills").alias("wanted"))
    return entity(spark, sf, "candidates").join(j, "id").select("id", F.array_join(F.array_union("skills", "wanted"), ",").alias("skills"))


@query("set05_toggle", "SELECT id, array_to_string(CASE WHEN list_contains(string_split(skills_csv, ','), 'Go') THEN list_filter(string_split(skills_csv, ','), lambda s: s <> 'Go') ELSE list_append(string_split(skills_csv, ','), 'Go') END, ',') AS skills FROM candidates", C)
def set05(spark, sf):
    has = F.array_contains("skills", "Go")
    return entity(spark, sf, "candidates").select("id", F.array_join(F.when(has, F.array_remove("skills", "Go")).otherwise(F.array_append("skills", F.lit("Go"))), ",").alias("skills"))


@query("set06_skills_concat", "SELECT c.id, concat(c.skills_csv, ',', j.skills_csv) AS skills, CAST(len(string_split(c.skills_csv, ',')) + len(string_split(j.skills_csv, ',')) AS BIGINT) AS n FROM candidates c JOIN jobs j ON j.id = c.id", ("candidates", "jobs"))
def set06(spark, sf):
    j = entity(spark, sf, "jobs").select("id", F.col("skills").alias("wanted"))
    rows = entity(spark, sf, "candidates").join(j, "id").withColumn("bag", F.concat("skills", "wanted"))
    return rows.select("id", F.array_join("bag", ",").alias("skills"), F.size("bag").cast("long").alias("n"))


@query("set07_except", "SELECT id FROM candidates EXCEPT SELECT candidate_id FROM applications WHERE stage = 'Hired'", ("candidates", "applications"))
def set07(spark, sf):
    return entity(spark, sf, "candidates").select("id").subtract(entity(spark, sf, "applications").where("stage = 'Hired'").select(F.col("candidate_id").alias("id")))
