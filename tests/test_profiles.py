"""Whole profiles from model output, aliases, and upserts by batch."""

import json
import re

from pyspark.sql import functions as F

from quarrylane.functions import text
from quarrylane.operators.experience import MOST, experience, windows
from quarrylane.operators.profiles import profile
from quarrylane.session import shared_dir
from quarrylane.sources import schemas
from quarrylane.streaming import ingest

ANSWER = {
    "headline": "Railway Signal Planner",
    "timeline": {"jobs": [{"organization": "Nordbahn Netz", "position": "Signal Planner", "workplace_type": "hybrid, two days", "duration": 19, "primary_technologies": ["AutoCAD", "Excel"], "end": "2025-03"}], "total_years": "7.5"},
    "skills": [{"name": "Interlocking", "proficiency": "sr."}, {"skill": "Welding", "level": "beginner", "details": "two courses"}, "Ada"],
    "education": [{"college": "Harbour Polytechnic", "graduation_date": "2011"}],
    "certifications": [{"cert_name": "Track Safety", "issuing_body": "Rail Board", "issued": 2019}],
    "notable_projects": [{"title": "Tunnel Renewal", "tools": ["AutoCAD"]}],
}


def parsed(spark, *docs):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string").select("i", profile(F.col("doc")).alias("p"))
    assert rows.schema["p"].dataType.simpleString() == schemas.profile().simpleString()
    return [r.p for r in rows.orderBy("i").collect()]


def test_whole_answer(spark):
    (p,) = parsed(spark, json.dumps(ANSWER))
    at = p.timeline.positions[0]
    assert (at.company_name, at.job_title, at.workplace_type, at.primary_technologies, at.end_date) == ("Nordbahn Netz", "Signal Planner", "Hybrid", ["AutoCAD", "Excel"], "2025-03")
    assert [(s.name, s.proficiency, s.context_evidence) for s in p.skills.detailed_skills] == [("Interlocking", "Advanced", None), ("Welding", "Beginner", "two courses"), ("Ada", "Intermediate", None)]
    assert (p.education[0].institution, p.education[0].graduation_year) == ("Harbour Polytechnic", "2011")
    assert (p.certifications[0].issuing_organization, p.certifications[0].issue_date) == ("Rail Board", "2019")
    assert (p.notable_projects[0].project_name, p.notable_projects[0].technologies_used) == ("Tunnel Renewal", ["AutoCAD"])
    assert p.timeline.total_continuous_years == 7.5 and p.candidate_id and p.anonymized_name == "[CANDIDATE_NAME]"


def test_other_shapes(spark):
    taxonomy = {"skills": {"core_languages": ["Rust"], "detailed_skills": [{"name": "Rust", "category": "Soft Skill"}]}, "timeline": {"jobs": [{}], "total_years": "6.5"}}
    loose = {"skills": {"tools": ["Git", "Make"], "years": 3}, "timeline": "long", "education": {}}
    a, b, empty, *bad = parsed(spark, json.dumps(taxonomy), json.dumps(loose), "{}", None, "", "[1]", "not JSON", '{"id": ')
    assert a.skills.core_languages == ["Rust"] and a.skills.detailed_skills[0].category == "Soft Skill"
    assert a.timeline.total_continuous_years == 6.5 and a.timeline.positions[0].company_name == "Unknown Company"
    assert [s.name for s in b.skills.detailed_skills] == ["Git", "Make"] and b.timeline.positions == [] and b.education == []
    assert empty.target_role_or_headline == "Software Professional" and empty.skills.detailed_skills == []
    assert bad == [None] * len(bad)


def test_batches_write_their_changes_alone(spark):
    store = f"{shared_dir(spark)}/store"
    schema = "id long, at int, stage string"
    write = ingest.upsert_into(store, "id", lambda d: d, order="at")
    first, second = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], schema), spark.createDataFrame([(2, 0, "y"), (2, 0, "z")], schema)
    write(first, 0)
    write(second, 1)
    got = sorted(map(tuple, ingest.latest_versions(spark, store).collect()))
    write(second.repartition(3), 1)
    assert got == sorted(map(tuple, ingest.latest_versions(spark, store).collect()))
    assert got[0] == (1, 3, "c") and got[1][:2] == (2, 0)
    assert spark.read.parquet(f"{store}/stream=batch/version=1").count() == 1


def test_experience_is_made_once_and_on_all_cores(spark):
    import __spark_entry__ as entry

    made = entry.queries()
    for name in ("t11_extract_experience", "dml09_profile"):
        plan = made[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan, name
    plan = made["t11_extract_experience"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan  # an inferred filter would make all items a second time


def test_profiles_have_an_item_for_each_period(spark, tmp_path):
    import __spark_entry__ as entry

    for name in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    own = [f"{y} - {y + 1}" for y in range(2001, 2015, 2)]
    customer = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where("c_custkey in (1, 5)")  # 5 has no period of its own
    customer.withColumn("c_name", F.lit("  ".join(own))).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.id: r for r in entry.queries()["dml09_profile"](spark, str(tmp_path)).collect()}
    assert [got[i].positions for i in (1, 5)] == [len(own) + 1, len(own)]
    told = [tuple(x[k] for k in ("role", "company", "period", "description")) for x in json.loads(got[5].experience)]
    assert [x[2] for x in told] == own and len(told) > MOST
    rows = entry.queries()["t11_extract_experience"](spark, str(tmp_path)).where("id = 5").drop("id").collect()
    assert sorted(map(tuple, rows)) == sorted(told)


def test_windows_are_those_of_the_text(spark):
    """Periods close together and far apart, at the ends, with characters of four bytes between them; more of them than a window has room for."""
    near, far = "2001-2003", "😀" * 300
    texts = ["", near, near * 50, f"{far}{near}", f"{near}{far}{near}x{near}", "20012003-20042005-2006", "\n".join(f"é{y} to present" for y in range(1990, 2020))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for most in (None, 2):
        got = {r.id: [tuple(w) for w in r.w] for r in rows.select("id", windows(F.col("t"), most).alias("w")).collect()}
        for i, t in enumerate(texts):
            found = list(re.finditer(text.PERIOD, t))[:most]
            assert got[i] == [(m.group(0), t[max(0, m.start() - 100) : m.end() + 200]) for m in found]
    items = experience(F.col("t"), F.lit("H"), F.array(F.lit("a")), most=None)
    assert [r.n for r in rows.orderBy("id").select(F.size(items).alias("n")).collect()] == [1, 1, 50, 1, 3, 2, 30]
