import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quarrylane.llm import language_model
from tests.llm.conftest import by_id
from tests.llm.test_models import FOLD, WORD

D = 0.75


def whole_model(texts, trained):
    """Scores by trigrams, bigrams and unigrams, none of which is left out."""
    tokens = {k: [*WORD.findall(t.translate(FOLD)), None] for k, t in texts.items()}
    uni = Counter(w for k in trained for w in tokens[k])
    pairs = Counter(p for k in trained for p in zip([None, *tokens[k]], tokens[k], strict=False))
    triples = Counter(p for k in trained for p in zip([None, *tokens[k]], tokens[k], tokens[k][1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    after, after2 = Counter(a for a, _ in pairs), Counter((a, b) for a, b, _ in triples)

    def two(a, w):
        base = (uni[w] + 1) / (n + v + 1)
        return max(pairs[a, w] - D, 0) / uni[a] + D * after[a] / uni[a] * base if uni[a] else base

    def three(u, a, w):
        c = pairs[u, a]
        return max(triples[u, a, w] - D, 0) / c + D * after2[u, a] / c * two(a, w) if c else two(a, w)

    return {k: math.log10(two(None, t[0])) + sum(math.log10(three(*x)) for x in zip([None, *t], t, t[1:], strict=False)) for k, t in tokens.items()}


@pytest.mark.parametrize("segments", [64, 256])
def test_op6_keeps_every_pair_and_triple(spark, sf, texts, monkeypatch, segments):
    monkeypatch.setattr(language_model, "SEGMENTS", segments)
    got = by_id(language_model.op6_language_model(spark, sf))
    for k, score in whole_model(texts, [k for k in texts if zlib.crc32(str(k).encode()) % 7 != 2]).items():
        assert got[k].score == pytest.approx(score, rel=4e-3)


def test_a_pair_seen_once_counts(spark):
    docs = [(k, f"c{k} d{k} e{k}") for k in range(9)]
    model = language_model.train(spark.createDataFrame(docs, "doc_id long, text string"))
    got = by_id(language_model.score(spark.createDataFrame([(1, "c1 d1 e1"), (2, "c1 d2 e3"), (3, "zz c1 d1 e1")], "doc_id long, text string"), model))
    base = 2 / (model.total + model.distinct + 1)
    two = 0.25 + 0.75 * base
    last = 0.25 + 0.75 * (0.25 / 1 + 0.75 * (10 / (model.total + model.distinct + 1)))
    first = 0.25 / 9 + 0.75 * base
    three = 0.25 + 0.75 * two
    assert got[1].score == pytest.approx(math.log10(first) + 2 * math.log10(three) + math.log10(last), rel=1e-6)
    assert got[1].score > got[2].score + 2 and np.isfinite(got[3].score)
