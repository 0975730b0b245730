"""The composite searches, the funnel, ingestion of résumés, and the pluggable models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylane.functions import numeric, text
from quarrylane.operators import models, recognition
from quarrylane.operators.experience import experience
from quarrylane.operators.profiles import profile
from quarrylane.plans import retrieval
from quarrylane.queries.aggregates import BM25
from quarrylane.queries.joins import BLOCKS, DEFAULT_SKILLS, _duck_skills, blocks, duck_tokens
from quarrylane.operators.layout import complex_pages
from quarrylane.registry import query
from quarrylane.session import spread
from quarrylane.sources.entities import entity, table

HYBRID = f"""{BM25}, br AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b),
dd AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings v),
dr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dd),
u AS (SELECT query_id, doc_id, rank, 'd' AS c FROM dr WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank, 'b' FROM br WHERE rank <= 50),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, max(CASE WHEN c = 'd' THEN rank END) AS dense_rank, max(CASE WHEN c = 'b' THEN rank END) AS bm25_rank FROM u GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) AS rank FROM f)"""


def inputs(spark, sf):
    """Documents with vectors of the same number; every benchmark item is a query, its vector that of its number."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = vectors.join(F.broadcast(queries.select(F.col("query_id").alias("doc_id"))), "doc_id").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    return docs, vectors, queries, asked


@query("dml07_hybrid_search", f"WITH {HYBRID} SELECT query_id, doc_id, round(rrf, 6) AS rrf, dense_rank, bm25_rank, rank FROM h WHERE rank <= 10")
def dml07(spark, sf):
    return retrieval.hybrid_search(*inputs(spark, sf)).select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"), "dense_rank", "bm25_rank", "rank")


@query("dml06_funnel", f"""WITH {HYBRID}, pp AS (SELECT h.query_id, h.doc_id, h.rank, coalesce(d.text, '') AS passage, list_distinct({duck_tokens('benchmark.text')}) AS qt, list_distinct({duck_tokens("coalesce(d.text, '')")}) AS pt FROM h JOIN benchmark ON item_id = query_id LEFT JOIN documents d ON d.doc_id = h.doc_id WHERE rank <= 100),
rr AS (SELECT query_id, doc_id, rank, passage, round(1 / (1 + exp(-(CASE WHEN len(qt) = 0 THEN -4 ELSE len(list_intersect(qt, pt)) / len(qt) * 8.0 - 4.0 END))), 4) AS rerank_score FROM pp),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank, CASE WHEN contains(passage, 'Staff') OR contains(passage, 'Senior') THEN 88.0 ELSE 45.0 END AS match_score FROM rr)
SELECT query_id, doc_id, rerank_score, rerank_rank, match_score, CASE WHEN match_score >= 80 THEN 'Strong Fit' ELSE 'Low Match' END AS tier, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, rerank_rank) AS position FROM k WHERE rerank_rank <= 20""")
def dml06(spark, sf):
    return retrieval.funnel(*inputs(spark, sf)).select("query_id", "doc_id", "rerank_score", "rerank_rank", "match_score", "tier", "position")


@query("dml09_regex_ingest", rf"""WITH f AS (SELECT id, {_duck_skills('raw_text')} AS s, raw_text FROM resumes)
SELECT id, coalesce(nullif(regexp_extract(raw_text, '{text.EMAIL}'), ''), '{text.NO_EMAIL}') AS email, coalesce(nullif(regexp_extract(raw_text, '{text.PHONE}'), ''), '{text.NO_PHONE}') AS phone,
array_to_string(CASE WHEN len(s) > 0 THEN s ELSE {DEFAULT_SKILLS} END, ',') AS skills, least(98, greatest(75, 80 + 2 * CASE WHEN len(s) > 0 THEN len(s) ELSE 6 END)) AS score FROM f""", ("resumes",))
def dml09(spark, sf):
    raw = F.col("raw_text")
    rows = entity(spark, sf, "resumes").select("id", text.email(raw).alias("email"), text.phone(raw).alias("phone"), text.skills(raw).alias("s"))
    return rows.select("id", "email", "phone", F.array_join("s", ",").alias("skills"), numeric.match_score(F.size("s")).cast("long").alias("score"))


@query("dml09_profile")
def dml09_profile(spark, sf):
    """The whole profile of each résumé, with an experience item for each of its periods, as JSON."""
    raw = F.col("raw_text")
    rows = spread(entity(spark, sf, "resumes").select("id", "raw_text")).withColumns({"name": text.name(raw), "headline": text.headline(raw), "skills": text.skills(raw)})
    rows = rows.withColumn("items", experience(raw, F.col("headline"), F.col("skills"), most=None))
    return rows.select(
        "id", "name", text.pseudonym(F.col("name")).alias("anonymized_name"), text.initials(F.col("name")).alias("avatar"), "headline", text.location(raw).alias("location"),
        text.linkedin(raw, F.col("name")).alias("linkedin"), text.education(raw).alias("education"), text.years_of_experience(raw).alias("years"), F.array_join("skills", ",").alias("skills"),
        F.size("items").alias("positions"), F.to_json("items").alias("experience"),
    )


@query("u01_embed_documents")
def u01(spark, sf):
    """Vectors by the offline embedder, as the sum of their components and their length."""
    rows = models.embed(table(spark, sf, "documents"), models.HashingEmbedder, "text")
    return rows.select("doc_id", F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("u02_embed_query")
def u02(spark, sf):
    rows = models.embed(table(spark, sf, "benchmark"), models.HashingEmbedder, "text", prefix=models.QUERY_PREFIX)
    return rows.select("item_id", F.size("vector").alias("n"), F.round(numeric.norm(F.col("vector")), 6).alias("length"))


@query("u03_cross_encoder", f"""WITH t AS (SELECT conv_id, turn, list_distinct({duck_tokens('text')}) AS pt, first_value(list_distinct({duck_tokens('text')})) OVER (PARTITION BY conv_id ORDER BY turn) AS qt FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(qt) = 0 THEN -4 ELSE len(list_intersect(qt, pt)) / len(qt) * 8.0 - 4.0 END, 6) AS raw_score FROM t""")
def u03(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("passage"))
    first = turns.groupBy("conv_id").agg(F.min_by("passage", "turn").alias("query"))
    return retrieval.model_scores(turns.join(first, "conv_id"), models.overlap_scorer).select("conv_id", "turn", F.round("raw_score", 6).alias("raw_score"))


@query("u04_ner_anonymise", rf"""SELECT id, CASE WHEN trim(t) = '' THEN '' ELSE regexp_replace(regexp_replace(t, '{text.EMAIL}', '[EMAIL_ADDRESS]', 'g'), '{text.PHONE}', '[PHONE_NUMBER]', 'g') END AS anonymised
FROM (SELECT id, replace(raw_text, c_name, '[CANDIDATE_NAME]') AS t FROM resumes JOIN customer ON c_custkey = id)""", ("resumes",))
def u04(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("person"))
    rows = entity(spark, sf, "resumes").join(names, "id")
    return models.anonymise(rows, "raw_text", F.array("person")).select("id", "anonymised")


PLACES = ("Austin, TX", "Munich, Germany")


@query("u04_spans", rf"""WITH s AS (SELECT id, 'PERSON' AS type, 1 AS start, length(c_name) AS size FROM resumes JOIN customer ON c_custkey = id WHERE id % 11 <> 0
UNION ALL SELECT id, 'PLACE', instr(raw_text, p), length(p) FROM resumes, (SELECT unnest({list(PLACES)}) AS p) WHERE contains(raw_text, p)
UNION ALL SELECT id, 'EMAIL_ADDRESS', instr(raw_text, v), length(v) FROM (SELECT id, raw_text, nullif(regexp_extract(raw_text, '{text.EMAIL}'), '') AS v FROM resumes) WHERE v IS NOT NULL
UNION ALL SELECT id, 'PHONE_NUMBER', instr(raw_text, v), length(v) FROM (SELECT id, raw_text, nullif(regexp_extract(raw_text, '{text.PHONE}'), '') AS v FROM resumes) WHERE v IS NOT NULL)
SELECT id, type, start - 1 AS start, start - 1 + size AS "end" FROM s""", ("resumes",))
def u04_spans(spark, sf):
    """Persons, places, addresses and numbers of all résumés, by a labeller fitted on a fifth of them, at most SAMPLE."""
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("person"))
    rows = entity(spark, sf, "resumes").join(names, "id")
    known = F.array(F.struct(F.lit("PERSON").alias("type"), "person"), *[F.struct(F.lit("PLACE").alias("type"), F.lit(p).alias("person")) for p in PLACES])
    placed = F.transform(known, lambda k: F.struct(k["type"].alias("type"), (F.instr(F.col("raw_text"), k["person"]) - 1).alias("start"), (F.instr(F.col("raw_text"), k["person"]) - 1 + F.length(k["person"])).alias("end")))
    some = recognition.sampled(rows.where("id % 5 = 0"), "raw_text")
    labelled = some.select(F.col("raw_text").alias("text"), F.filter(placed, lambda s: s["start"] >= 0).alias("spans"))
    found = recognition.recognised(spread(rows.select("id", "raw_text")), "raw_text", recognition.fit(labelled))
    return found.select("id", F.inline("spans")).select("id", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("u05_extract_profile")
def u05(spark, sf):
    """Profiles from model output: what doesn't parse is marked."""
    return models.parse_profiles(entity(spark, sf, "llm_json"), "doc").select("id", "parsed", "overall")


@query("u05_whole_profile", """SELECT id, target_headline AS headline, location AS company, CASE WHEN id % 2 = 0 THEN 0.0 ELSE years_of_experience END AS years, CASE WHEN id % 2 = 0 THEN 'Present' ELSE '2024' END AS end_date,
skills_csv AS skills, CASE WHEN id % 3 = 0 THEN 'Expert' ELSE 'Intermediate' END AS level, coalesce(highest_education, 'Degree / Certificate') AS degree,
CAST(1990 + id % 30 AS VARCHAR) AS graduated, CASE WHEN id % 2 = 0 THEN 'Certifying Body' ELSE source END AS issuer FROM candidates""", ("candidates",))
def u05_whole_profile(spark, sf):
    """Answers in the shapes that models give (lists or objects, aliases, bare names), parsed into whole profiles."""
    even, s = F.col("id") % 2 == 0, F.col("skills")
    old = F.to_json(F.array(F.struct(F.col("location").alias("employer"), F.lit(12).alias("duration"))))
    new = F.to_json(F.struct(F.array(F.struct(F.col("location").alias("company_name"), F.lit("2024").alias("to"))).alias("jobs"), F.col("years_of_experience").alias("total_years")))
    levels = F.to_json(F.transform(s, lambda x: F.struct(x.alias("skill"), F.lit("an expert").alias("level"))))
    skills = F.when(F.col("id") % 3 == 0, levels).when(F.col("id") % 3 == 1, F.to_json(s)).otherwise(F.to_json(F.struct(s.alias("my_tools"))))
    taught = F.to_json(F.array(F.struct(F.col("highest_education").alias("qualification"), (1990 + F.col("id") % 30).alias("year_of_completion"))))
    issued = F.to_json(F.array(F.struct(F.lit("CKA").alias("cert_name"), F.when(~even, F.col("source")).alias("issuer"))))
    parts = {"timeline": F.when(even, old).otherwise(new), "skills": skills, "education": taught, "certifications": issued}
    doc = F.concat(F.lit('{"headline": "'), "target_headline", F.lit('"'), *[x for k, v in parts.items() for x in (F.lit(f', "{k}": '), v)], F.lit("}"))
    p = entity(spark, sf, "candidates").select("id", doc.alias("doc")).select("id", profile(F.col("doc")).alias("p"))
    first, detailed = F.col("p.timeline.positions")[0], F.col("p.skills.detailed_skills")
    return p.select(
        "id", F.col("p.target_role_or_headline").alias("headline"), first["company_name"].alias("company"), F.col("p.timeline.total_continuous_years").alias("years"),
        first["end_date"].alias("end_date"), F.array_join(detailed["name"], ",").alias("skills"), detailed[0]["proficiency"].alias("level"),
        F.col("p.education")[0]["degree"].alias("degree"), F.col("p.education")[0]["graduation_year"].alias("graduated"),
        F.col("p.certifications")[0]["issuing_organization"].alias("issuer"),
    )


RULED = "contains(target_headline, 'Staff') OR contains(target_headline, 'Senior')"


@query("u06_deep_evaluate", f"SELECT id, id % 10 <> 3 AS success, CASE WHEN id % 10 <> 3 THEN CASE WHEN {RULED} THEN 88.0 ELSE 45.0 END END AS score, CASE WHEN id % 10 = 3 THEN 'no answer' END AS error FROM candidates", ("candidates",))
def u06(spark, sf):
    rows = entity(spark, sf, "candidates").select("id", F.when(F.col("id") % 10 != 3, F.col("target_headline")).alias("profile"))
    return models.evaluate(rows, models.rule_evaluator).select("id", "success", "score", "error")


@query("u07_simple_evaluate", f"SELECT id, CASE WHEN id % 10 = 3 THEN 75.0 WHEN {RULED} THEN 88.0 ELSE 45.0 END AS match_score, CASE WHEN id % 10 = 3 THEN 'Potential Fit' WHEN {RULED} THEN 'Strong Fit' ELSE 'Low Match' END AS tier FROM candidates", ("candidates",))
def u07(spark, sf):
    rows = models.evaluate(entity(spark, sf, "candidates").select("id", F.when(F.col("id") % 10 != 3, F.col("target_headline")).alias("profile")), models.rule_evaluator)
    tier = F.when(~F.col("success"), "Potential Fit").otherwise(F.when(F.col("score") >= 80, "Strong Fit").otherwise("Low Match"))
    return rows.select("id", F.coalesce("score", F.lit(75.0)).alias("match_score"), tier.alias("tier"))


@query("u08_decode_pages")
def u08(spark, sf):
    return models.decode(table(spark, sf, "pages"), models.html_decoder, "html").select("page_id", F.length("decoded").alias("n"), F.md5("decoded").alias("md5"))


@query("u09_layout_test", f"""WITH {BLOCKS}, s AS (SELECT page, count(*) FILTER (WHERE x1 <= 315) AS l, count(*) FILTER (WHERE x1 > 315 AND x0 >= 285) AS r FROM blocks GROUP BY page),
o AS (SELECT l.page, count(*) AS o FROM blocks l JOIN blocks r ON l.page = r.page AND l.x1 <= 315 AND r.x1 > 315 AND r.x0 >= 285 AND greatest(l.y0, r.y0) < least(l.y1, r.y1) GROUP BY l.page)
SELECT s.page, s.l >= 2 AND s.r >= 2 AND coalesce(o.o, 0) >= 2 AS is_complex FROM s LEFT JOIN o ON o.page = s.page""")
def u09(spark, sf):
    return complex_pages(blocks(spark, sf), F.lit(600.0))
