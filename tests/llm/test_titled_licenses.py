from quarrylane.llm import licenses
from tests.llm.conftest import by_id


def test_titled_texts_and_headers_are_known(spark):
    titled = [f"{title}\n\nCopyright (c) 2020 A. Person\n\n{licenses.TEXTS[name]}" for name, titles in licenses.TITLES.items() for title in titles]
    names = [name for name, titles in licenses.TITLES.items() for _ in titles]
    texts = [*titled, *licenses.HEADERS.values(), "Words.\nMIT License\nMore words."]
    got = by_id(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[k].license_id for k in range(len(texts))] == [*names, *licenses.HEADERS, None]
    assert got[len(texts) - 1].notice_ids == "MIT"


def test_statements_in_the_bodys_line_and_spellings_side_by_side(spark):
    mit = " ".join(licenses.TEXTS["MIT"].split())
    bsd = " ".join(licenses.TEXTS["BSD-2-Clause"].split())
    texts = [f"Copyright (c) 2020 A. Person. {mit}", f"Copyright 2019 X, all rights reserved. {bsd}", "Copyright a\ncopyright b\nLicence licence favour favour words"]
    docs = spark.createDataFrame([*enumerate(texts), (7, "Released under the MIT License."), (7, "nothing")], "doc_id long, text string")
    rows = licenses.license_scan(docs, {"license license favor favor words": "Twice"}).collect()
    assert sorted((r.doc_id, r.license_id, r.n_notices) for r in rows if r.doc_id < 7) == [(0, "MIT", 0), (1, "BSD-2-Clause", 0), (2, "Twice", 1)]
    assert sorted(r.n_notices for r in rows if r.doc_id == 7) == [0, 1]  # a repeated identifier: each row has its own


def test_native_plan_with_one_canonical_form(spark, sf):
    plan = licenses.op1_license_scan(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("sha2(") == 1 and plan.count("Relation [") == 1
