"""Text functions over documents and résumés."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylane.functions import text
from quarrylane.operators.experience import experience
from quarrylane.queries.joins import DEFAULT_SKILLS, _duck_skills, duck_tokens
from quarrylane.plans.text_search import contained
from quarrylane.registry import query
from quarrylane.session import spread
from quarrylane.sources.entities import entity, table

R, C = ("resumes",), ("candidates",)
LINES = "l AS (SELECT id, raw_text, list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM resumes)"
ROLE = " OR ".join(f"contains(lower(x), '{r}')" for r in text.ROLES)
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def resumes(spark, sf):
    return entity(spark, sf, "resumes")


@query("t01_tokenize", f"SELECT doc_id, array_to_string({duck_tokens('text')}, ' ') AS tokens FROM documents")
def t01(spark, sf):
    # Tokens are compared as the oracle can see them, with letters that aren't ASCII as one character.
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query("t02_extract_name", rf"WITH {LINES} SELECT id, coalesce(CASE WHEN length(l[1]) < 50 AND NOT regexp_matches(l[1], '{text.NOT_A_NAME}') THEN l[1] END, CASE WHEN length(l[2]) < 50 THEN l[2] END, 'Candidate') AS name FROM l", R)
def t02(spark, sf):
    return resumes(spark, sf).select("id", text.name(F.col("raw_text")).alias("name"))


@query("t03_extract_headline", f"WITH {LINES} SELECT id, coalesce(list_filter(l[2:5], lambda x: ({ROLE}) AND length(x) < 80 AND NOT contains(x, '@'))[1], 'Software Engineer') AS headline FROM l", R)
def t03(spark, sf):
    return resumes(spark, sf).select("id", text.headline(F.col("raw_text")).alias("headline"))


@query("t04_extract_email", f"SELECT id, coalesce(nullif(regexp_extract(raw_text, '{text.EMAIL}'), ''), '{text.NO_EMAIL}') AS email FROM resumes UNION ALL SELECT -1 - doc_id, coalesce(nullif(regexp_extract(text, '{text.EMAIL}'), ''), '{text.NO_EMAIL}') FROM documents", R)
def t04(spark, sf):
    docs = table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("id"), text.email(F.col("text")).alias("email"))
    return resumes(spark, sf).select("id", text.email(F.col("raw_text")).alias("email")).unionByName(docs)


@query("t05_extract_phone", rf"SELECT id, coalesce(nullif(regexp_extract(raw_text, '{text.PHONE}'), ''), '{text.NO_PHONE}') AS phone FROM resumes UNION ALL SELECT -1 - doc_id, coalesce(nullif(regexp_extract(text, '{text.PHONE}'), ''), '{text.NO_PHONE}') FROM documents", R)
def t05(spark, sf):
    docs = table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("id"), text.phone(F.col("text")).alias("phone"))
    return resumes(spark, sf).select("id", text.phone(F.col("raw_text")).alias("phone")).unionByName(docs)


@query("t06_extract_linkedin", rf"SELECT id, concat('linkedin.com/in/', coalesce(nullif(regexp_extract(raw_text, '{text.LINKEDIN}', 1), ''), replace(lower(c_name), ' ', ''))) AS linkedin FROM resumes JOIN customer ON c_custkey = id", R)
def t06(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return resumes(spark, sf).join(names, "id").select("id", text.linkedin(F.col("raw_text"), F.col("c_name")).alias("linkedin"))


BAD = " OR ".join(f"contains(lower({{0}}), '{w}')" for w in text.NOT_A_PLACE)
PLACE = ", ".join(f"p{k}" for k in range(2))


@query("t07_extract_location", rf"""WITH p AS (SELECT id, {STRIP.format(f"regexp_extract(raw_text, '{text.PLACES[0]}', 1)")} AS a, {STRIP.format(f"regexp_extract(raw_text, '{text.PLACES[1]}', 1)")} AS b FROM resumes)
SELECT id, coalesce(CASE WHEN a <> '' AND length(a) < 40 AND NOT ({BAD.format('a')}) THEN a END, CASE WHEN b <> '' AND length(b) < 40 AND NOT ({BAD.format('b')}) THEN b END, '{text.NO_PLACE}') AS location FROM p""", R)
def t07(spark, sf):
    return resumes(spark, sf).select("id", text.location(F.col("raw_text")).alias("location"))


@query("t08_extract_skills", f"WITH f AS (SELECT id, {_duck_skills('raw_text')} AS s FROM resumes) SELECT id, len(s) AS n, array_to_string(s, ',') AS skills FROM f", R)
def t08(spark, sf):
    rows = resumes(spark, sf).select("id", text.found_skills(F.col("raw_text")).alias("s"))
    return rows.select("id", F.size("s").cast("long").alias("n"), F.array_join("s", ",").alias("skills"))


@query("t09_extract_education", rf"""WITH p AS (SELECT id, {STRIP.format(f"regexp_extract(raw_text, '{text.DEGREES[0]}', 1)")} AS a, {STRIP.format(f"regexp_extract(raw_text, '{text.DEGREES[1]}', 1)")} AS b FROM resumes)
SELECT id, coalesce(CASE WHEN length(a) > 5 AND length(a) < 100 THEN a END, CASE WHEN length(b) > 5 AND length(b) < 100 THEN b END, '{text.NO_DEGREE}') AS education FROM p""", R)
def t09(spark, sf):
    return resumes(spark, sf).select("id", text.education(F.col("raw_text")).alias("education"))


@query("t10_years_of_experience", rf"WITH y AS (SELECT id, list_min(list_transform(regexp_extract_all(raw_text, '{text.YEAR}', 1), lambda y: CAST(y AS INTEGER))) AS y FROM resumes) SELECT id, CASE WHEN y BETWEEN 1990 AND 2026 AND 2026 - y BETWEEN 1 AND 30 THEN CAST(2026 - y AS DOUBLE) ELSE 4.0 END AS years FROM y", R)
def t10(spark, sf):
    return resumes(spark, sf).select("id", text.years_of_experience(F.col("raw_text")).alias("years"))


@query("t11_extract_experience")
def t11(spark, sf):
    raw = F.col("raw_text")
    rows = spread(resumes(spark, sf).select("id", "raw_text"))
    # There is always an item; with explode() a filter on their number would be inferred, and all be made twice.
    full = rows.select("id", F.explode_outer(experience(raw, text.headline(raw), text.skills(raw), most=None)).alias("e"))
    return full.select("id", "e.role", "e.company", "e.period", "e.description")


@query("t12_initials", "SELECT id, coalesce(nullif(upper(array_to_string(list_transform(list_filter(string_split_regex(target_headline, '\\s+'), lambda w: w <> '')[1:2], lambda w: w[1]), '')), ''), 'CA') AS initials FROM candidates", C)
def t12(spark, sf):
    return entity(spark, sf, "candidates").select("id", text.initials(F.col("target_headline")).alias("initials"))


@query("t13_pseudonym")
def t13(spark, sf):
    return entity(spark, sf, "candidates").select("id", text.pseudonym(F.col("name")).alias("anonymized_name"))


@query("t14_clean_block", f"WITH {LINES} SELECT id, len(l) AS n, array_to_string(l, '|') AS lines FROM l", R)
def t14(spark, sf):
    rows = resumes(spark, sf).select("id", text.lines(F.col("raw_text")).alias("l"))
    return rows.select("id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("lines"))


@query("t15_ilike_pattern", "SELECT c.id, c.location FROM candidates c JOIN region ON c.location ILIKE concat('%', trim(concat(' ', lower(r_name), ' ')), '%')", C)
def t15(spark, sf):
    regions = table(spark, sf, "region").select(F.concat(F.lit("%"), F.trim(F.concat(F.lit(" "), F.lower("r_name"), F.lit(" "))), F.lit("%")).alias("pattern"))
    return entity(spark, sf, "candidates").join(F.broadcast(regions), F.expr("location ILIKE pattern")).select("id", "location")  # five regions


@query("t16_short_id", "SELECT id, concat('job-', substr(md5(CAST(id AS STRING)), 1, 8)) AS short_id FROM candidates", C)
def t16(spark, sf):
    return entity(spark, sf, "candidates").select("id", text.short_id("job-", F.col("id"), 8).alias("short_id"))


@query("t17_redact", rf"SELECT id, CASE WHEN trim(raw_text) = '' THEN '' ELSE regexp_replace(regexp_replace(raw_text, '{text.EMAIL}', '[EMAIL_ADDRESS]', 'g'), '{text.PHONE}', '[PHONE_NUMBER]', 'g') END AS redacted FROM resumes", R)
def t17(spark, sf):
    return resumes(spark, sf).select("id", text.redact(F.col("raw_text")).alias("redacted"))


@query("t18_detect_pii", rf"""WITH k AS (SELECT id, 'EMAIL_ADDRESS' AS entity, unnest(regexp_extract_all(raw_text, '{text.EMAIL}')) AS value FROM resumes
UNION ALL SELECT id, 'PHONE_NUMBER', unnest(regexp_extract_all(raw_text, '{text.PHONE}')) FROM resumes) SELECT id, entity, value, CASE entity WHEN 'EMAIL_ADDRESS' THEN 1.0 ELSE 0.75 END AS score FROM k""", R)
def t18(spark, sf):
    def spans(kind: str, pattern: str, score: float):
        found = F.regexp_extract_all("raw_text", F.lit(pattern), F.lit(0))
        return F.transform(found, lambda v: F.struct(F.lit(kind).alias("entity"), v.alias("value"), F.lit(score).alias("score")))

    every = F.concat(spans("EMAIL_ADDRESS", text.EMAIL, 1.0), spans("PHONE_NUMBER", text.PHONE, 0.75))
    return resumes(spark, sf).select("id", F.inline(every)).where("score >= 0.6")


@query("t19_contains_verbatim", "SELECT d.doc_id, count(*) FILTER (WHERE contains(d.text, b.text)) AS cited FROM documents d, benchmark b GROUP BY d.doc_id")
def t19(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cited = contained(docs, table(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))).groupBy("doc_id").agg(F.count("*").alias("cited"))
    return docs.select("doc_id").join(cited, "doc_id", "left").fillna(0, "cited")
