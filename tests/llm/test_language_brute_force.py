"""Operator 10 restated character by character."""

import math
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.llm import language_id as L


def features(text):
    """The feature of each place and length, by the definition of the hash."""
    chars = [ord(c) for c in text.lower()]
    out = []
    for i in range(len(chars)):
        h = 0
        for n in range(L.GRAMS):
            c = chars[i + n] if i + n < len(chars) else 0
            h = ((h ^ c) * int(L._MIX)) % 2**32
            h ^= h >> 15
            out.append(((h * int(L._MIX)) % 2**32) >> (32 - L.BITS))
    return out


@pytest.fixture(scope="module")
def docs(documents):
    return documents.withColumn("text", F.substring("text", 1, 1500))  # the restatement is slow


@pytest.fixture(scope="module")
def model(docs):
    return L.train(docs.where(L.remainder("doc_id", 3) != 1))


def test_predictions_are_sums_over_characters(docs, model):
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in L.identify(docs).collect():
        text = rows[r.doc_id] or ""
        found = features(text)
        logits = [sum(float(model.table[f, k]) for f in found) / max(len(text.lower()), 1) + model.bias[k] for k in range(len(model.languages))]
        e = [math.exp((x - max(logits)) / model.temperature) for x in logits]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if any(unicodedata.category(c).startswith("L") for c in text):
            assert r.lang_pred == model.languages[int(np.argmax(e))] and r.score == pytest.approx(max(e) / sum(e), abs=1e-4)
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_all_labelled_rows_are_counted(docs, model):
    learned = [r.text for r in docs.where(L.remainder("doc_id", 3) != 1).where("lang is not null and text is not null").collect()]
    seen = np.zeros(1 << L.BITS, bool)
    for t in learned:
        seen[features(t)] = True
    assert (model.seen == seen).all()


def test_labels_of_held_out_rows_are_never_read(docs):
    other = docs.withColumn("lang", F.when(L.remainder("doc_id", 3) == 1, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("elsewhere"))
    assert sorted(L.identify(docs).collect()) == sorted(L.identify(other).collect())
