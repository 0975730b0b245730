"""Very long texts and words: results as from the libraries or from short pieces, in bounded memory."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarrylane.llm import language_id, language_model, pii, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")


def peak(call):
    tracemalloc.start()
    out = call()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_op4_long_words():
    rng, library = random.Random(1), Tokenizer.from_file(JSON)
    own = token_counts.Counter(JSON)
    for text in ("".join(rng.choices("acgt", k=150_000)), "the" * 60_000, "".join(rng.choices("etaoin", k=100_000)) + "'s 12" + "é" * 70_000, "=" * 200_000):
        assert own.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    assert len(own.transducer.states) <= token_counts.STATES


def test_op4_states_are_bounded_within_a_word(monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 500)
    monkeypatch.setattr(token_counts, "CHUNK", 4_000)
    text = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    own = token_counts.Counter(JSON)
    assert own.counts([text]) == [len(Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids)]
    assert len(own.transducer.states) <= 501


def test_op6_words_across_blocks(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab \n\té", k=rng.randint(0, 90))) for _ in range(60)] + ["x" * 700, " ", "y" * 256 + " " + "y" * 256]
    want = language_model.sequences(texts)
    for size in (1, 2, 7, 64, 256):
        monkeypatch.setattr(language_model, "BLOCK_BYTES", size)
        got = language_model.sequences(texts)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert want[0][-3] == want[0][-2] and len(set(want[0].tolist())) > 50


def test_op7_long_parts_and_many_spans():
    assert pii.rule_spans("ip 1.2.3." + "0" * 5000 + "1 end") == [("ip", 3, 9 + 5001)]
    assert pii.rule_spans("ip 1.2.3." + "9" * 5000) == []
    text = "mail a@b.co, +1 (555) 010-9999, 10.0.0.1, 4111 1111 1111 1111,\n" * 30_000
    detector = pii.Detector(pii.boosting.Forest(5.0), {k: 0.5 for k in pii.KINDS})
    base, spans = detector.spans(text)
    assert len(base) >= 120_000 and set(base) <= set(spans)
    assert len(pii.examples(text)) <= 3 * pii.PER_DOCUMENT


def test_op7_intervals():
    rng = random.Random(4)
    for _ in range(300):
        spans = [("ip", a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        own = pii.Intervals(spans)
        for _ in range(20):
            a = rng.randint(0, 70)
            b = a + rng.randint(1, 6)
            free = all(y <= a or b <= x for _, x, y in spans)
            assert own.free(a, b) == free
            if free:
                own.add(a, b)
                spans.append(("ip", a, b))


def small_model(languages=3):
    rng = np.random.default_rng(5)
    size = 1 << language_id.BITS
    return language_id.Model([f"l{k}" for k in range(languages)], rng.normal(size=(size, languages)).astype(np.float32), np.zeros(languages), 1.0, rng.random(size) < 0.5)


def test_op10_pieces_are_the_whole(monkeypatch):
    model, rng = small_model(), random.Random(6)
    texts = ["".join(rng.choices("abcé İß中", k=n)) for n in (0, 1, 2, 3, 50, 400, 1000)]
    want = model.probabilities(texts)
    counts = [x.copy() for x in language_id._counts(texts)]
    assert [int(x.sum()) for x in counts] == [3 * len(t.lower()) for t in texts]
    for size in (1, 2, 5, 64):
        monkeypatch.setattr(language_id, "PIECE", size)
        got = model.probabilities(texts)
        assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(want, got, strict=True))
        assert all((a == b).all() for a, b in zip(counts, language_id._counts(texts), strict=True))


@pytest.mark.parametrize("languages", [20])
def test_op10_memory_of_long_texts(languages):
    model, text = small_model(languages), "some words of a long text " * 200_000  # 5.2 million characters
    _, most = peak(lambda: model.probabilities([text]))
    assert most < 300e6
