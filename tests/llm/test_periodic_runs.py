import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quarrylane.llm.periodic_runs import find_runs, kept_words, op13_periodic_runs, runs_of, shared_words, strongest


def brute(words, least=24, exponent=3):
    """Every period against every place."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : j + q]
            if length >= max(least, exponent * q) and not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def batch(texts):
    return np.array([w for t in texts for w in t], np.int64), np.append(0, np.cumsum([len(t) for t in texts]))


def periodised(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 3), (4, 2), (24, 2)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least * 10 + exponent)
    texts = [[rng.randrange(letters) for _ in range(rng.randrange(90))] for letters in (1, 2, 2, 3, 5) for _ in range(12)]
    for _ in range(40):  # periodic stretches between noise, also nested ones
        inner = [rng.randrange(3) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9)
        texts.append([rng.randrange(4) for _ in range(rng.randrange(9))] + (inner + [rng.randrange(3)]) * rng.randrange(1, 5) + inner)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    thue = [i.bit_count() % 2 for i in range(256)]
    texts += [fib[-1], thue, [], [7], [7] * 24, [7] * 23]
    found = runs_of(*batch(texts), least, exponent)
    for d, t in enumerate(texts):
        assert found.get(d, []) == brute(t, least, exponent), (d, t)


def test_no_run_is_shorter_than_what_it_shares_with_itself():
    assert shared_words(24, 3) == 16
    assert all(max(24, 3 * q) - q >= 16 for q in range(1, 500))


def test_long_runs_and_many_periods_stay_fast():
    one, two = [5] * 60_000, list(range(20_000)) * 3
    found = runs_of(*batch([one, two, list(range(50_000))]))
    assert found == {0: [(0, 60_000, 1)], 1: [(0, 60_000, 20_000)]}


def test_kept_and_strongest():
    assert kept_words(10, [(1, 6, 2), (2, 6, 2)]).tolist() == [True, True, True, False, False, False, False, False, True, True]
    assert strongest([(0, 30, 10), (5, 24, 8), (40, 30, 9)]) == (40, 30, 9)
    assert strongest([(3, 30, 10), (0, 24, 8)]) == (0, 24, 8)
    assert strongest([]) is None


def test_odd_rows(spark, edge, empty):
    rows = find_runs(edge).collect()
    assert len(rows) == edge.count()
    by = {r.id: r for r in rows if r.id is not None}
    assert [tuple(r) for r in by[5].runs] == [(0, 60_000, 3)] and by[5].collapsed == "lorem ipsum dolor"
    assert by[3].n_words == by[4].n_words == by[9].n_words == 0 and by[9].collapsed == "" and by[9].runs == []
    assert sum(r.id == 7 for r in rows) == 2 and sum(r.id is None for r in rows) == 2
    assert find_runs(empty).count() == 0


def test_query_equals_brute_force(spark, sf, texts):
    rows = {r.doc_id: r for r in op13_periodic_runs(spark, sf).collect()}
    assert rows.keys() == texts.keys()
    some = 0
    for d, text in texts.items():
        words = periodised(text.encode().split(), d)
        codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
        short = len(words) <= 400
        runs = brute([codes[w] for w in words]) if short else [tuple(r) for r in runs_of(*batch([[codes[w] for w in words]])).get(0, [])]
        some += bool(runs)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        r = rows[d]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    assert some > 5
