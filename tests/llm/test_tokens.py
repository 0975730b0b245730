import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrylane.llm import bpe, packing, token_counts
from quarrylane.llm.pretoken import split
from tests.llm.conftest import by_id

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(JSON)
PATTERN = regex.compile(public_tokenizers.PATTERN)


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = st.text(st.one_of(st.sampled_from(" \n\t'strevmld.,!é²Ⅷ　\xa0\x85\x1c中ß_0A🙂"), st.characters(codec="utf-8")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_split_is_the_pattern(texts):
    words, counts = split(texts)
    want = [PATTERN.findall(t) for t in texts]
    assert words == [w for each in want for w in each] and counts.tolist() == [len(each) for each in want]


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_encode_is_the_library(text):
    own = bpe.codec(RANKS)
    (ids,) = bpe.encode([text], RANKS)
    assert ids == tik_once().encode_ordinary(text) and own.decode(ids) == text.encode()


_TIK = []


def tik_once():
    if not _TIK:
        _TIK.append(tik())
    return _TIK[0]


@settings(max_examples=200, deadline=None)
@given(ODD, st.integers(1, 30))
def test_counts_and_chunks(text, size):
    own, whole = token_counts.counter(JSON), token_counts.CHUNK
    want = len(LIBRARY.encode(text, add_special_tokens=False).ids)
    try:
        assert own.counts([text]) == [want]
        token_counts.CHUNK = size
        assert own.counts([text]) == [want]
    finally:
        token_counts.CHUNK = whole


def test_every_token_alone():
    own = token_counts.counter(JSON)
    words = sorted({w for t in bpe.codec(RANKS).tokens if (s := t.decode("utf-8", "replace")) for w in PATTERN.findall(s)})
    assert [own.transducer.count(w) for w in words] == [len(e.ids) for e in LIBRARY.encode_batch(words, add_special_tokens=False)]
    assert [bpe.codec(RANKS).word(w) for w in words] == [tik_once().encode_ordinary(w) for w in words]


def test_op3(spark, sf, texts):
    got = by_id(bpe.op3_byte_bpe(spark, sf))
    assert set(got) == set(texts)
    for k, t in texts.items():
        ids = tik_once().encode_ordinary(t)
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_edges(edge, empty):
    rows = bpe.encode_table(edge, RANKS).collect()
    assert len(rows) == 13 and [r.ids for r in rows if r.doc_id == 3] == [[]]
    back = {r.doc_id: r.decoded for r in bpe.decode_table(bpe.encode_table(edge.where("doc_id in (5, 8)"), RANKS), RANKS).collect()}
    want = {r.doc_id: r.text for r in edge.where("doc_id in (5, 8)").collect()}
    assert {k: bytes(v).decode() for k, v in back.items()} == want
    assert bpe.round_trip(edge, RANKS).count() == 13 and bpe.round_trip(empty, RANKS).count() == 0


def test_op4(spark, sf, texts):
    got = by_id(token_counts.op4_token_counts(spark, sf))
    for k, t in texts.items():
        n = len(LIBRARY.encode(t, add_special_tokens=False).ids)
        assert tuple(got[k]) == (k, len(t.encode()), n, n > 1024)
    assert len(got) == len(texts)


def test_count_edges(edge, empty):
    got = [tuple(r) for r in token_counts.token_counts(edge, JSON, limit=3).collect()]
    assert len(got) == 13 and (3, 0, 0, False) in got and (4, 0, 0, False) in got and got.count(next(g for g in got if g[0] == 7)) == 2
    eight = next(r.text for r in edge.where("doc_id = 8").collect())
    assert next(g for g in got if g[0] == 8)[2] == len(LIBRARY.encode(eight, add_special_tokens=False).ids)
    assert token_counts.token_counts(empty, JSON).count() == 0


def check_packing(rows, texts, size=1024):
    """texts: (doc_id, text) pairs, doc ids unique."""
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for k, own in pieces.items():
        ids = np.array([*LIBRARY.encode(texts[k], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return 1 - sum(r.length for r in rows) / (size * len(bins))


def test_op8(spark, sf, texts):
    assert check_packing(packing.op8_packing(spark, sf).collect(), texts) < 0.02


def test_packing_edges(edge, empty):
    rows = packing.pack(edge.where("doc_id is not null and doc_id <> 7"), RANKS).collect()
    check_packing(rows, {r.doc_id: r.text or "" for r in edge.where("doc_id is not null and doc_id <> 7").collect()})
    again = packing.pack(edge, RANKS, size=64).collect()
    assert sum(r.start == 0 for r in again) == 13 and packing.pack(empty, RANKS).count() == 0


def test_packer_keeps_few_windows():
    rng = random.Random(1)
    packer = packing.Packer(100, 0, limit=4)
    out, total = [], 0
    for k in range(500):
        n = rng.randint(1, 180)
        total += n
        out += packer.add(k, b"\1\0\0\0" * n)
        assert len(packer.windows) <= 4
    out += packer.leftovers()
    assert sum(r[2] for r in out) == total
    fills = {}
    for r in out:
        fills[r[6]] = fills.get(r[6], 0) + r[2]
    assert max(fills.values()) <= 100 and sum(100 - f for f in fills.values()) / (100 * len(fills)) < 0.08
