"""Catalogues and citations against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylane.functions import text as T
from quarrylane.plans import text_search as S
from quarrylane.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def word_in(entry, text):
    low, text = entry.lower(), text.lower()
    word = lambda c: c.isalnum() or c == "_"
    at = [m.start() for m in re.finditer(f"(?={re.escape(low)})", text)]
    side = lambda i: 0 <= i < len(text) and word(text[i])
    return any(side(i - 1) != side(i) and side(i + len(low) - 1) != side(i + len(low)) for i in at)


def test_a_catalogue_of_many_entries(spark, monkeypatch):
    rng = random.Random(6)
    entries = [f"skill{i}" for i in range(100_000)] + ["C++", "c#", "Go", "GO", ".NET", "naïve Bayes", "a", "", None]
    catalogue = spark.createDataFrame([(e, i) for i, e in enumerate(entries)], "entry string, place long")
    texts = [" ".join(rng.choice([f"skill{rng.randrange(120_000)}", "Go", "go-lang", "gopher", "C++", "C++x", "xc#y", "x .NET y", "x.NETy", "NAïVE BAYES", "A."]) for _ in range(rng.randrange(12))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "id long, text string")
    few = [e for e in entries[100_000:] if e]
    mentioned = lambda t: sorted({int(n) for n in re.findall(r"\bskill(\d+)\b", t) if int(n) < 100_000})
    want = {i: [f"skill{n}" for n in mentioned(t)] + [e for e in few if word_in(e, t)] for i, t in enumerate(texts)}
    for limit in (300_000, 16 << 20):  # several passes, and one
        monkeypatch.setattr(S, "AUTOMATON_BYTES", limit)
        got = {r.id: r.found for r in S.catalogue_matches(docs, catalogue).collect()}
        assert {i: got[i] for i in want} == want and got[60] is None and got[61] == []
    small = S.catalogue_matches(docs, catalogue.limit(3))
    assert abs(len(plan(S.catalogue_matches(docs, catalogue))) - len(plan(small))) < 400


def test_the_given_catalogue_as_by_expressions(spark, sf):
    catalogue = spark.createDataFrame([(s, i) for i, s in enumerate(T.SKILLS)], "entry string, place long")
    from quarrylane.sources.entities import entity

    rows = entity(spark, sf, "resumes").select("id", "raw_text")
    both = S.catalogue_matches(rows, catalogue, "raw_text").withColumn("want", T.found_skills(F.col("raw_text")))
    assert both.where(~F.col("found").eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é中"])
def test_citations_of_all_lengths(spark, alphabet):
    rng = random.Random(len(alphabet))
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 300))) for _ in range(40)] + ["".join(rng.choices(alphabet, k=20_000)), "", None]
    quotes = [""]
    for size in [*range(1, 60), 200, 1000, 10_000]:
        t = rng.choice([x for x in texts if x and len(x) >= size])
        at = rng.randrange(len(t) - size + 1)
        quotes += [t[at : at + size], t[at : at + size - 1] + "!", "".join(rng.choices(alphabet, k=size))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, q) for i, q in enumerate([*quotes, None])], "quote_id long, quote string")
    found = S.contained(docs, asked)
    want = {(i, j) for i, t in enumerate(texts) if t is not None for j, q in enumerate(quotes) if q in t}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)


def test_every_stretch_shares_a_fingerprint():
    rng = random.Random(1)
    for _ in range(50):
        data = bytes(rng.choices(b"abc", k=rng.randrange(S.LONG, 400)))
        own = set(S.fingerprints(data).tolist())
        for at in range(len(data) - S.LONG + 1):
            assert set(S.fingerprints(data[at : at + rng.randrange(S.LONG, 60)]).tolist()) & own
            assert set(S.fingerprints(data[at : at + S.LONG]).tolist()) <= own


def test_no_nested_loops(spark, sf):
    text = plan(QUERIES["t19_contains_verbatim"](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_empty_tables(spark):
    docs, quotes = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "quote_id long, quote string")
    assert S.contained(docs, quotes).count() == 0
    assert S.catalogue_matches(docs, spark.createDataFrame([], "entry string, place long")).count() == 0
