import corpus_pipeline
import numpy as np

from quarrylane.llm import near_copies


def similarity(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a | b))


def planted(rng, n, low, high):
    """Pairs of texts whose similarity lies in [low, high)."""
    out = []
    while len(out) < n:
        words = [f"w{x}" for x in rng.integers(0, 50_000, rng.integers(80, 400))]
        copy = list(words)
        for at in rng.integers(0, len(words), max(1, round(len(words) * (1 - (low + high) / 2) / 9))):
            copy[at] = f"x{rng.integers(1 << 40)}"
        if low <= similarity(" ".join(words), " ".join(copy)) < high:
            out.append((" ".join(words), " ".join(copy)))
    return out


def test_recall_by_similarity(spark):
    """Every band from 0.8 on is caught (4 bits of a fingerprint reach few of the first), none below it."""
    rng = np.random.default_rng(5)
    edges = [(0.7, 0.795), (0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)]
    docs, band = [], {}
    for k, (low, high) in enumerate(edges):
        for a, b in planted(rng, 60, low, high):
            band[len(docs) + 1] = k
            docs += [(len(docs), a), (len(docs) + 1, b)]
    left = {r.doc_id for r in corpus_pipeline.dissimilar(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    recall = [np.mean([d not in left for d, x in band.items() if x == k]) for k in range(len(edges))]
    print(dict(zip(edges, recall, strict=True)))
    assert recall == [0, 1, 1, 1, 1] and all(d - 1 in left for d in band)


def test_rows_are_told_apart(spark):
    """Near and equal copies leave one row, whatever their identifiers; a repeated identifier's other text stays."""
    long = " ".join(f"word{k}" for k in range(100))
    docs = [(1, long), (1, long + " end"), (2, long.upper()), (2, "quite another text that stays here"), (None, long), (3, "a b"), (4, "A  b"), (5, None), (6, " "), (None, "")]
    left = corpus_pipeline.dissimilar(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in left) == [1, 2, 3, 5] and {r.text for r in left if r.doc_id == 2} == {docs[3][1]}


def test_operator_9_proposes(spark):
    """Texts within four bits meet by operator 9's search, whatever the bands; those that are far from all others don't."""
    rng = np.random.default_rng(8)
    docs = [t for pair in planted(rng, 40, 0.95, 1.0) for t in pair] + ["some other text " * 3, ""]
    values, starts = near_copies.shingle_sets(docs)
    sets = [values[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    fps = [near_copies.simhash.majority(s) for s in sets]
    rows = [(k, len(s), int(np.array([f], np.uint64).view(np.int64)[0])) for k, (s, f) in enumerate(zip(sets, fps, strict=True))]
    keys = {r.node: r.key for r in near_copies.fingerprint_keys(spark.createDataFrame(rows, "node long, shingles long, fp long")).collect()}
    near = [k for k in range(0, 80, 2) if (fps[k] ^ fps[k + 1]).bit_count() <= 4]
    assert len(near) > 25 and all(keys[k] == keys[k + 1] for k in near)
    assert len(keys) == 2 * len(near) and len(set(keys.values())) == len(near)


def test_sets_are_exact():
    texts = ["a b c d e f g", "A b C", "", "a b c d e a b c d e a b", "x"]
    values, starts = near_copies.shingle_sets(texts)
    assert np.diff(starts).tolist() == [3, 1, 0, 5, 1] and len(set(values.tolist())) == 9


def families(rng, sizes, words=120, changed=1):
    """Texts in families of these sizes: each member has some words of its family's text replaced; the first is that text."""
    out = []
    for n in sizes:
        base = [f"w{x}" for x in rng.integers(0, 50_000, words)]
        for k in range(n):
            copy = list(base)
            for at in rng.integers(0, words, changed if k else 0):
                copy[at] = f"x{rng.integers(1 << 40)}"
            out.append(" ".join(copy))
    return out


def classes(texts):
    """By brute force: for each text the first text that links of 0.8 or more reach."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def chain(rng, n, words=120):
    """Texts of which each is like the next alone: a word is replaced at another place each time."""
    text, out = [f"c{x}" for x in rng.integers(0, 50_000, words)], []
    for at in rng.permutation(words)[:n]:
        text[at] = f"y{rng.integers(1 << 40)}"
        out.append(" ".join(text))
    return out


def test_large_groups_equal_brute_force(spark, monkeypatch):
    """Whatever the size of blocks, groups are those of all pairs: copies of one text, chains, unlike texts in one band."""
    rng = np.random.default_rng(8)
    texts = families(rng, [60, 25, 1, 2]) + families(rng, [40], changed=3) + chain(rng, 30) + families(rng, [50], changed=4)[1:]
    want = classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumn("doc_id", near_copies.F.col("row"))
    for block, weight in ((2048, 1 << 20), (5, 1 << 20), (2048, 900)):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        monkeypatch.setattr(near_copies, "WEIGHT", weight)
        got = dict(enumerate(range(len(texts)))) | {r.row: r.keep for r in near_copies.near_copies(docs, "row").collect()}
        assert [got[k] for k in range(len(texts))] == want, (block, weight)


def test_meetings_of_copies_grow_with_them(spark, monkeypatch):
    """Copies of one text travel to the pivots and hardly ever again: four times as many make about four times as many trips."""
    monkeypatch.setattr(near_copies, "BLOCK", 100)
    seen = []
    links = near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda texts, met, least: (seen.append(met.count()), links(texts, met, least))[1])
    trips = []
    for n in (400, 1600):
        rows = list(enumerate(families(np.random.default_rng(n), [n], changed=2)))
        docs = spark.createDataFrame(rows, "row long, text string").withColumn("doc_id", near_copies.F.col("row"))
        seen.clear()
        assert near_copies.near_copies(docs, "row").where("keep = 0").count() == n
        trips.append(sum(seen))
    print(trips)
    assert trips[1] < 5 * trips[0] and trips[1] < 2 * 1600
