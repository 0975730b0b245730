import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quarrylane.llm.spelling import DEEP, neighbours, op11_spelling, spelling_groups, word_counts


def apart(a, b):
    """Whether one insertion, deletion or replacement makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(words):
    """Pairs by common deletions and wildcards, then compared."""
    by = defaultdict(set)
    for w in words:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
            by[w[:i] + "?" + w[i + 1 :]].add(w)
    return {(a, b) for group in by.values() for a in group for b in group if apart(a, b)}


def pairs(spark, words):
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    rows = neighbours(df).collect()
    n = {w: i + 1 for i, w in enumerate(words)}
    assert all(r.n == n[r.word] and r.other_n == n[r.other] for r in rows)
    found = [(r.word, r.other) for r in rows]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("letters,low,high", [("ab", 1, 7), ("abcdé", 3, 8), ("aÿ", 7, 11)])
def test_neighbours_equal_brute_force(spark, letters, low, high):
    rng = random.Random(low * 100 + high)
    words = sorted({"".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(700)})
    found = pairs(spark, words)
    assert found == brute(words) and len(found) > 100


def test_very_long_words(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("abc", k=3 * DEEP + 7))
    other = "".join(rng.choices("abc", k=3000))
    words = {base, other, "a" * 200, "a" * 201, "a" * 202, "b" * (DEEP + 1), "b" * DEEP, "b" * (DEEP - 1), "x" + base}
    for i in (0, 1, DEEP - 2, DEEP, DEEP + 1, 2 * DEEP, 3 * DEEP + 6):
        words |= {base[:i] + base[i + 1 :], base[:i] + "z" + base[i:], base[:i] + "y" + base[i + 1 :]}
    words |= {other[:1500] + "q" + other[1500:], other[:2999], other[1:]}
    words = sorted(words)
    assert pairs(spark, words) == {(a, b) for a in words for b in words if apart(a, b)}


def test_forms_and_roots(spark):
    rows = [("colours", 5000), ("colour", 400), ("colou", 40), ("kolou", 3), ("colouss", 500), ("colourz", 501), (None, 9), ("alone", 2)]
    got = {r.word: r for r in spelling_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert set(got) == {w for w, _ in rows if w}
    assert (got["colour"].form, got["colour"].form_n, got["colour"].root) == ("colours", 5000, "colours")
    assert (got["colou"].form, got["colou"].root, got["kolou"].root) == ("colour", "colours", "colours")
    assert (got["colouss"].form, got["colourz"].form) == ("colours", None)
    assert (got["alone"].n_near, got["alone"].root, got["alone"].form) == (0, "alone", None)
    ties = spark.createDataFrame([("bat", 30), ("cat", 30), ("aat", 3)], "word string, n long")
    assert {r.word: r.form for r in spelling_groups(ties).collect()} == {"bat": None, "cat": None, "aat": "bat"}
    assert spelling_groups(ties.limit(0)).count() == 0


def reference_counts(rows, misspell):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if not h % misspell:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def test_counts_of_odd_rows(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    for misspell in (2, 31):
        assert {r.word: r.n for r in word_counts(edge, misspell=misspell).collect()} == reference_counts(rows, misspell)
    assert word_counts(empty).count() == 0


def test_query_equals_brute_force(spark, sf, texts):
    rows = {r.word: r for r in op11_spelling(spark, sf).collect()}
    n = reference_counts(texts.items(), 31)
    assert rows.keys() == n.keys() and all(rows[w].n == n[w] for w in n)
    near = defaultdict(set)
    for a, b in brute(n):
        near[a].add(b)
    form = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    assert form
    for w, r in rows.items():
        root = w
        while root in form:
            root = form[root]
        assert (r.n_near, r.form, r.form_n, r.root) == (len(near[w]), form.get(w), n.get(form.get(w)), root)
