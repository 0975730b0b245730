import math
import re
import uuid
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylane.functions import coercion, numeric, text
from quarrylane.operators import layout, models
from quarrylane.operators.experience import experience
from quarrylane.plans import quality, retrieval


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_tokens_lose_symbols_at_word_ends(spark):
    got = one(spark, text.tokens(F.col("t")), t="C++ and .NET, CI/CD; low-latency _foo-bar Node.js a 3.5 TEAM")
    assert got == ["net", "ci", "cd", "low", "latency", "foo-bar", "node.js", "3.5"] and got == models.terms("C++ and .NET, CI/CD; low-latency _foo-bar Node.js a 3.5 TEAM")


def slow_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = [models.terms(d) for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for own in toks for t in set(own))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: eps * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * own.count(t) * (k1 + 1) / (own.count(t) + k1 * (1 - b + b * len(own) / avg)) for t in models.terms(query)) for own in toks]


def test_bm25_against_a_plain_restatement(spark):
    docs = ["kafka stream kafka java", "java spring service", "python pandas spark kafka", "java java java", "nothing here", "spark spark stream"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    q = "java java kafka stream unknown"
    found = {r.doc_id: r.score for r in retrieval.lexical_search(retrieval.lexical_index(frame), spark.createDataFrame([(1, q)], "query_id long, text string")).collect()}
    want = {i: s for i, s in enumerate(slow_bm25(docs, q)) if s > 0}
    assert set(found) == set(want) and all(found[i] == pytest.approx(want[i], abs=1e-8) for i in want)


def test_fusion_sums_reciprocal_ranks_and_orders_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank long")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank long")
    got = {r.doc_id: r for r in retrieval.fuse({"dense": a, "bm25": b}).collect()}
    assert got[11].rrf == pytest.approx(1 / 61 + 1 / 62) and got[10].bm25_rank is None and got[12].dense_rank is None


def test_cosine_of_zero_vectors_is_zero(spark):
    assert one(spark, numeric.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 2.0]) == 0.0


def test_vector_search_filters(spark):
    rows = [(1, "Senior Backend Architect", 7.5, "San Francisco, CA", "Master of Science", ["Python", "FastAPI"]), (2, "Junior", 2.0, "San Francisco, CA", "Bachelor of Science", ["Python"]), (3, "Lead", 9.0, "Austin, TX", "PhD", ["Kubernetes"]), (4, "Senior", 6.0, "Remote", "Master of Engineering", ["Go"])]
    c = spark.createDataFrame([(*r, [float(r[0]), 1.0]) for r in rows], "id long, target_headline string, years_of_experience double, location string, highest_education string, skills array<string>, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, vector array<float>")
    ids = lambda **f: {r.id for r in retrieval.vector_search(c, q, retrieval.VectorFilters(**f)).collect()}
    assert ids(min_years=5) == {1, 3, 4} and ids(location="San Francisco") == {1, 2, 4} and ids(education=("Master", "PhD")) == {1, 3, 4}
    assert ids(min_years=5, location="San Francisco", education=("Master",)) == {1, 4} and ids(skills=("Python",)) == {1, 2} and ids(location="") == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        ids(limit=101)


def test_dense_search_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(90, [0.0, 0.0, 0.0]), (91, None), (92, [1.0])]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    q = v.where("doc_id < 9").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(retrieval.dense_search(v, q, 7).collect())
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(retrieval.dense_search(v.repartition(5), q, 7).collect()) == whole and len(whole) == 63
    c = v.where("size(embedding) = 3").crossJoin(q.withColumnRenamed("vector", "w")).select("query_id", "doc_id", F.round(numeric.cosine(F.col("embedding"), F.col("w")), 9).alias("score"))
    assert sorted(retrieval.top(c, 7, [F.desc("score"), F.asc("doc_id")], ["query_id"]).collect()) == whole


def test_empty_corpus_gives_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    vectors = spark.createDataFrame([], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, "java")], "query_id long, text string")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")
    assert retrieval.funnel(docs, vectors, queries, asked).count() == 0


def test_metrics(spark):
    results = spark.createDataFrame([(1, d, d) for d in range(1, 30)] + [(2, 5, 1)], "query_id long, doc_id long, rank long")
    relevant = spark.createDataFrame([(1, 3), (1, 7), (1, 40), (2, 9)], "query_id long, doc_id long")
    got = {r.query_id: r for r in quality.retrieval_metrics(results, relevant, spark.createDataFrame([(1,), (2,), (3,)], "query_id long")).collect()}
    assert got[1].recall_5 == pytest.approx(1 / 3) and got[1].recall_10 == pytest.approx(2 / 3) and got[1].mrr_20 == pytest.approx(1 / 3)
    assert (got[2].recall_5, got[2].mrr_20) == (0, 0) and (got[3].recall_20, got[3].mrr_20) == (1, 1)


def test_hybrid_recall_on_a_seeded_corpus(spark):
    domains = {"backend": "Python FastAPI PostgreSQL Kafka", "frontend": "React TypeScript CSS Redux", "data": "Spark Airflow Snowflake Pandas", "cloud": "AWS Terraform Kubernetes Docker", "security": "SOC2 OAuth Vault TLS"}
    docs = [(k * 5 + j, f"Candidate {k} - {d} specialist. Core: {' '.join(w for i, w in enumerate(words.split()) if (k + i) % 4)}.") for j, (d, words) in enumerate(domains.items()) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(j, f"{d} engineer with deep skill in {words}") for j, (d, words) in enumerate(domains.items())], "query_id long, text string")
    vectors = models.embed(frame, models.HashingEmbedder, "text").select("doc_id", F.col("vector").alias("embedding"))
    asked = models.embed(queries, models.HashingEmbedder, "text").select("query_id", "vector")
    found = retrieval.hybrid_search(frame, vectors, queries, asked, 20)
    relevant = spark.createDataFrame([(i % 5, i) for i, _ in docs], "query_id long, doc_id long")
    assert quality.retrieval_metrics(found, relevant, queries).agg(F.avg("recall_20")).first()[0] >= 0.85


def test_rerank_and_rules(spark):
    pairs = spark.createDataFrame([(1, 1, 1, "kafka java", "kafka only"), (1, 2, 2, "kafka java", "java and kafka")], "query_id long, doc_id long, rank long, query string, passage string")
    rows = retrieval.rerank(pairs).orderBy("rerank_rank").collect()
    assert [r.doc_id for r in rows] == [2, 1] and rows[0].rerank_score > rows[1].rerank_score
    scored = retrieval.model_scores(pairs, models.overlap_scorer).select("raw_score").collect()
    assert [r.raw_score for r in scored] == [0.0, 4.0]


@pytest.mark.parametrize("raw, want", [("4", 4), ("9", 5), ("0", 1), ("4.5", 3), ("many", 3)])
def test_score_1_to_5(spark, raw, want):
    assert one(spark, coercion.score_1_to_5(F.col("v")), v=raw) == want


def test_categories_and_uuid(spark):
    assert one(spark, coercion.category(F.col("v"), coercion.TIER), v="Highly fitting") == "Strong Fit"
    assert one(spark, coercion.category(F.col("v"), coercion.TIER), v="Low Match") == "Low Match"
    assert one(spark, coercion.stable_uuid(F.col("v")), v="cand-1") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "cand-1"))
    for given_ in ("A9B1C2D3-e4f5-4a6b-8c7d-0123456789AB", "{a9b1c2d3e4f54a6b8c7d0123456789ab}", "urn:uuid:a9b1c2d3-e4f5-4a6b-8c7d-0123456789ab"):
        assert one(spark, coercion.stable_uuid(F.col("v")), v=given_) == str(uuid.UUID(given_))
    assert [one(spark, coercion.stable_uuid(F.col("v")), v=x) for x in ("é 1", "")] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, "é 1")), None]


def test_resume_fields(spark):
    raw = "Jane Doe\nSenior Data Engineer\njane@x.org  +1-555-010-2345\nAustin, TX\nMaster of Science in Physics\nC++, Go and Apache Spark\n2015 - Present"
    row = spark.createDataFrame([(raw,)], "t string").select(text.name(F.col("t")).alias("n"), text.headline(F.col("t")).alias("h"), text.email(F.col("t")).alias("e"), text.location(F.col("t")).alias("l"), text.skills(F.col("t")).alias("s"), text.years_of_experience(F.col("t")).alias("y"), text.redact(F.col("t")).alias("r")).first()
    assert (row.n, row.h, row.e, row.l, row.y) == ("Jane Doe", "Senior Data Engineer", "jane@x.org", "Austin, TX", 11.0)
    assert row.s == ["Go", "C", "Apache Spark"] and "[EMAIL_ADDRESS]" in row.r and "555" not in row.r


def test_experience_items(spark):
    """Each period looks 100 characters back and 200 on; its lines tell role, company and what was done."""
    first = "Harbour pilot\nQuay Technologies\n2001 - 2003\nwrote the berth planning tool that all pilots use"
    far = "." * 250
    raw = f"{first}\n{far}\n  Lead Analyst  \nBlue Labs\n2004 to 2009\n2010 is not described\n{far}\n2011—Present\n{far}\n2012 - 2013"
    rows = [(1, raw), (2, ""), (3, None), (4, "2015 - Present")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("skills", F.array(*[F.lit(x) for x in "abcdef"]))
    got = {r.id: [tuple(x) for x in r.e] for r in df.select("id", experience(F.col("t"), F.lit("H"), F.col("skills")).alias("e")).collect()}
    assert [x[2] for x in got[1]] == ["2001 - 2003", "2004 to 2009", "2011—Present"]  # three at most
    assert got[1][0][:2] == ("H", "Quay Technologies") and got[1][0][3] == "wrote the berth planning tool that all pilots use..."
    assert got[1][1][:2] == ("Lead Analyst", "Blue Labs") and got[1][1][3].endswith("...")
    assert got[4] == [("H", "Technology Solutions", "2015 - Present", "Contributed to core development and platform engineering utilizing a, b, c.")]
    made = [("H", "Core Platform Engineering", "2022 — Present", "Led development of scalable services and cloud infrastructure with a, b, c, d.")]
    assert got[2] == got[3] == made


@given(st.text(max_size=60))
def test_terms_are_lower_case_words(t):
    assert all(len(x) > 1 and x == x.lower() and re.search("[a-z0-9]", x) for x in models.terms(t))


def test_layout(spark):
    block = "page long, x0 double, y0 double, x1 double, y1 double"
    two = [(1, 10.0, y, 290.0, y + 9) for y in (0.0, 10.0)] + [(1, 310.0, y, 590.0, y + 9) for y in (0.0, 10.0)]
    single = [(2, 10.0, y, 590.0, y + 9) for y in (0.0, 10.0, 20.0)]
    got = {r.page: r.is_complex for r in layout.complex_pages(spark.createDataFrame(two + single, block), F.lit(600.0)).collect()}
    assert got == {1: True, 2: False}
    ordered = one(spark, layout.reading_order(F.array(F.struct(F.lit(5.0).alias("y0"), F.lit(0.0).alias("x0"), F.lit("b ").alias("text"), F.lit(0).alias("type")), F.struct(F.lit(1.0).alias("y0"), F.lit(0.0).alias("x0"), F.lit(" a").alias("text"), F.lit(0).alias("type")), F.struct(F.lit(0.0).alias("y0"), F.lit(0.0).alias("x0"), F.lit("img").alias("text"), F.lit(1).alias("type")))))
    assert ordered == "a\n\nb"


def test_failures_are_rows(spark):
    rows = models.evaluate(spark.createDataFrame([("Staff engineer",), (None,)], "profile string"), models.rule_evaluator).collect()
    assert [(r.success, r.score) for r in rows] == [(True, 88.0), (False, None)]
