"""Filters, facets and searches by secondary indexes, with the same results as their scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylane.plans import bitmaps, vector_index
from quarrylane.plans.retrieval import dense_search
from quarrylane.registry import query
from quarrylane.session import shared_dir
from quarrylane.sources.entities import entity, table

C, J = ("candidates",), ("jobs",)


@query("f13_trigram_index", "SELECT id, title FROM jobs WHERE contains(lower(title), 'widget') OR contains(lower(department), 'widget')", J)
def f13(spark, sf):
    rows = entity(spark, sf, "jobs")
    return bitmaps.containing(rows, bitmaps.trigram_index(rows, "id", ["title", "department"]), "WIDGET", ["title", "department"]).select("id", "title")


@query("f04_trigram_index", "SELECT id, location FROM candidates WHERE location ILIKE '%an_, asia' OR location ILIKE 'rem%ote'", C)
def f04(spark, sf):
    rows = entity(spark, sf, "candidates")
    return bitmaps.matching(rows, bitmaps.trigram_index(rows, "id", ["location"]), ["%an_, asia", "rem%ote"], "location").select("id", "location")


def skill_index(rows):
    return bitmaps.build(rows, "id", {"skills": F.col("skills"), "stage": F.array("stage"), "status": F.array("status")})


@query("f06_bitmap_index", "SELECT id, skills_csv FROM candidates WHERE list_has_all(string_split(skills_csv, ','), ['Python', 'Docker']) AND stage IN ('Offer', 'Contacted')", C)
def f06(spark, sf):
    rows = entity(spark, sf, "candidates")
    index = skill_index(rows)
    chosen = bitmaps.both([bitmaps.all_of(index, "skills", ["Python", "Docker"]), bitmaps.any_of(index, "stage", ["Offer", "Contacted"])])
    return bitmaps.rows_of(rows, index, chosen).select("id", "skills_csv")


@query("agg18_facets", """WITH c AS (SELECT id, stage, status, string_split(skills_csv, ',') AS s FROM candidates)
SELECT 'skills' AS key, v AS value, count(*) AS n FROM (SELECT unnest(s) AS v, stage, status FROM c) WHERE stage IN ('Offer', 'Interview') AND status IN ('Active') GROUP BY 2
UNION ALL SELECT 'stage', stage, count(*) FROM c WHERE list_has_all(s, ['Python', 'Git']) AND status IN ('Active') GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM c WHERE list_has_all(s, ['Python', 'Git']) AND stage IN ('Offer', 'Interview') GROUP BY 2""", C)
def agg18_facets(spark, sf):
    """Each facet's counts under the other facets' filters."""
    index = skill_index(entity(spark, sf, "candidates"))
    return bitmaps.facets(index, ["skills", "stage", "status"], {"skills": ["Python", "Git"], "stage": ["Offer", "Interview"], "status": ["Active"]}, every=("skills",))


@query("dml08_vector_graph", "SELECT vec_id AS query_id, 10 AS hits, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def dml08_graph(spark, sf):
    """How many of each query's ten nearest vectors of other labels than 0 the index gives, and whether 0.95 of all queries' are the exact ones."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    asked = vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = vector_index.build_index(vectors, shared_dir(spark), ["label"])
    found = vector_index.nearest(index, asked, 10, lambda a: a["label"] != 0)
    exact = dense_search(vectors.where("label <> 0"), asked, 10).select("query_id", "doc_id", F.lit(1).alias("right"))
    both = found.join(exact, ["query_id", "doc_id"], "left")
    share = both.agg((F.count("right") >= 0.95 * F.count("*")).alias("enough"))
    return both.groupBy("query_id").agg(F.count("*").cast("int").alias("hits")).crossJoin(F.broadcast(share))  # one row
