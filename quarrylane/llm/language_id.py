"""Operator 10, language identification, by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three lower-cased characters; a text's term frequencies are relative ones, so
that a prediction is a sum over its characters, whatever its length. Document frequencies are counted over all
labelled rows; weights are learned on a bounded sample of them by follow-the-regularised-leader with elastic-net
penalties, on another part of which the temperature of the probabilities is set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.common import SMALL_CHARS, chunks, forget, table
from quarrylane.llm.pretoken import LETTER, classes

BITS = 16
GRAMS = 3
#: Labelled rows of each language that weights are learned from, about (rows are taken by a hash of their identifier).
SAMPLE = 1200
#: Scale of the relative frequencies, so that features are about one.
SCALE = 60.0
#: Characters that are worked on at once.
PIECE = 1 << 19
UNKNOWN = "und"
_MIX = np.uint32(0x9E3779B1)


def _rounds(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Pieces of lower-cased texts, a bounded number of characters at a time.

    Each time: the pieces' texts, where each piece begins, its code points (gaps between pieces are NUL and count as no
    character) and a feature for each position and n. A long text is cut; its pieces see the characters behind the cut.
    """
    owners: list[int] = []
    parts: list[str] = []
    sizes: list[int] = []
    held = 0

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        c = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        out, h = [], np.zeros(len(c), np.uint32)
        for n in range(GRAMS):
            h = (h ^ np.concatenate((c[n:], np.zeros(n, np.uint32)))) * _MIX
            h ^= h >> np.uint32(15)
            out.append((h * _MIX) >> np.uint32(32 - BITS))
        own = np.arange(len(c)) - np.repeat(starts, list(map(len, parts))) < np.repeat(sizes, list(map(len, parts)))
        return np.array(owners), starts, np.where(own, c, 0), out

    for k, text in enumerate(texts):
        low = text.lower()
        for at in range(0, max(len(low), 1), PIECE):
            owners.append(k)
            parts.append(low[at : at + PIECE + GRAMS - 1] + "\0" * (GRAMS - 1))
            sizes.append(min(PIECE, len(low) - at))
            held += sizes[-1]
            if held >= PIECE:
                yield done()
                owners, parts, sizes, held = [], [], [], 0
    if owners:
        yield done()


def _counts(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the count of every feature."""
    at, held = 0, np.zeros(1 << BITS, np.int64)
    for owners, starts, c, grams in _rounds(texts):
        for owner, a, b in zip(owners.tolist(), starts.tolist(), [*starts[1:].tolist(), len(c)], strict=True):
            if owner != at:
                yield held
                at, held = owner, np.zeros(1 << BITS, np.int64)
            own = c[a:b] != 0
            held += np.bincount(np.concatenate([g[a:b][own] for g in grams]), minlength=1 << BITS)
    if texts:
        yield held


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (features, languages) float32: idf * weight * SCALE / GRAMS
    bias: np.ndarray
    temperature: float
    seen: np.ndarray  # features that some labelled text has

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) probabilities, whether each text has a letter, and its share of features seen in learning."""
        logits, chars, letters, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), bool), np.zeros(len(texts))
        for owners, starts, c, grams in _rounds(texts):
            total = self.table[grams[0]]
            for g in grams[1:]:
                total += self.table[g]
            total[c == 0] = 0
            np.add.at(logits, owners, np.add.reduceat(total, starts, axis=0, dtype=np.float64))
            np.add.at(chars, owners, np.add.reduceat((c != 0).astype(np.int64), starts))
            np.add.at(seen, owners, np.add.reduceat(sum(self.seen[g].astype(np.int8) for g in grams) * (c != 0), starts, dtype=np.int64))
            np.logical_or.at(letters, owners, np.logical_or.reduceat((classes()[c] == LETTER) & (c != 0), starts))
        chars = np.maximum(chars, 1)
        return _softmax((logits / chars[:, None] + self.bias) / self.temperature), letters, seen / chars / GRAMS


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes_: int, features: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, classes) and bias by FTRL-proximal over sparse rows (indices, values)."""
    z, n = np.zeros((2, features + 1, classes_))
    order = np.random.default_rng(seed)

    def weights(k: np.ndarray) -> np.ndarray:
        zk = z[k]
        w = -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2)
        return np.where(np.abs(zk) > l1, w, 0.0)

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            k, v = np.append(rows[r][0], features), np.append(rows[r][1], 1.0)
            w = weights(k)
            p = _softmax(v @ w)
            p[labels[r]] -= 1
            g = v[:, None] * p
            nk = n[k]
            z[k] += g - (np.sqrt(nk + g * g) - np.sqrt(nk)) / alpha * w
            n[k] = nk + g * g
    w = weights(np.arange(features + 1))
    return w[:-1], w[-1]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learn from rows with a label (others are left out); None where there are none.

    Document frequencies cover all rows. Weights come from about `sample` rows of each language (fewer if it has
    fewer), the rows whose hashed identifier is lowest; one in five of those sets the temperature instead.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not sizes:
        return None
    languages = list(sizes)
    share = {lang: min(1.0, sample / n) for lang, n in sizes.items()}
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's document frequencies (lang -1) and its sampled rows, counts as packed features."""
        df = np.zeros(1 << BITS, np.int64)
        schema = pa.schema([("lang", pa.int32()), ("held", pa.bool_()), ("docs", pa.int64()), ("index", pa.binary()), ("value", pa.binary())])
        docs = 0
        for langs, draws, texts in chunks(batches, "lang", "draw", "text", size=1_000_000):
            for lang, at, counts in zip(langs, draws, _counts(texts), strict=True):
                index = np.flatnonzero(counts)
                df[index] += 1
                docs += 1
                if at is not None and at < share[lang]:
                    held = int(at * (1 << 30)) % 5 == 0
                    yield pa.record_batch([[languages.index(lang)], [held], [int(counts.sum())], [index.astype("<u2").tobytes()], [counts[index].astype("<u4").tobytes()]], schema=schema)
        if docs:
            index = np.flatnonzero(df)
            yield pa.record_batch([[-1], [False], [docs], [index.astype("<u2").tobytes()], [df[index].astype("<u4").tobytes()]], schema=schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index, value in zip(batch.column("index").to_pylist(), batch.column("value").to_pylist(), strict=True):
                yield pa.record_batch({"feature": pa.array(np.frombuffer(index, "<u2").astype(np.int32)), "n": pa.array(np.frombuffer(value, "<u4").astype(np.int64))})

    seen = table(rows.select("lang", draw.alias("draw"), "text").mapInArrow(run, "lang int, held boolean, docs long, index binary, value binary"))
    df, docs = np.zeros(1 << BITS), sum(sizes.values())
    for feature, n in seen.where("lang < 0").select("index", "value").mapInArrow(unpack, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect():
        df[feature] = n
    got = []
    for r in seen.where("lang >= 0").toLocalIterator():
        value = np.frombuffer(r["value"], "<u4")
        got.append((r.lang, r.held, np.frombuffer(r["index"], "<u2").astype(np.int64), (value / max(r.docs, 1)).astype(np.float32)))
    idf = np.log((1 + docs) / (1 + df)) + 1
    got.sort(key=lambda x: (x[0], len(x[2]), float(x[3].sum()), x[2].tobytes()))
    x = [(index, value * idf[index] * SCALE) for _, _, index, value in got]
    y, held = np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], bool)
    if not held.any() or held.all():
        held[:] = False
    fit = np.flatnonzero(~held)
    w, bias = ftrl([x[i] for i in fit], y[fit], len(languages), 1 << BITS)
    logits = np.array([v @ w[k] + bias for k, v in (x[i] for i in (np.flatnonzero(held) if held.any() else fit))]).reshape(-1, len(languages))
    return Model(languages, (w * idf[:, None] * SCALE / GRAMS).astype(np.float32), bias, calibrate(logits, y[held] if held.any() else y[fit]), df > 0)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, *keep, lang_pred, score): the likeliest language of each whole text and its probability.

    `und` with score 0 where the text is null or has no letter, or nothing could be learned.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # at most 2 ** BITS float32 for each language
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    names = [f.name for f in rows.schema if f.name != "text"]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model | None = held.value
        for batch in batches:
            langs, scores = [], []
            for (texts,) in chunks(iter([batch]), "text", size=1_000_000):
                if own is None:
                    langs += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                p, letters, _ = own.probabilities(texts)
                best = p.argmax(axis=1)
                langs += [own.languages[k] if has else UNKNOWN for k, has in zip(best.tolist(), letters.tolist(), strict=True)]
                scores += np.where(letters, p.max(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    done = rows.mapInArrow(run, out)
    return done.select(F.col("id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 1.2, seen: float = 0.6, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has a language; null and letterless texts go.

    Its probability has to be `least` times that of a blind guess among the languages (or one), and a share of `seen`
    of its n-grams must occur in labelled texts, which those of unlearned scripts do not.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own: Model | None = held.value
        for batch in batches:
            keep: list[bool] = []
            for (texts,) in chunks(iter([batch]), text_col, size=SMALL_CHARS):
                if own is None:
                    keep += [False] * len(texts)
                else:
                    p, letters, share = own.probabilities(texts)
                    keep += (letters & (p.max(axis=1) >= min(1.0, least / len(own.languages)) - 1e-9) & (share >= seen)).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(id_col: str, mod: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Train on the labelled rows whose crc32(id) mod 3 is not 1 and predict all: (doc_id, held_out, lang_pred, score).

    Predictions see the text alone. Null and letterless texts are `und` with score 0; a null identifier is held out (it
    is never learned from); repeated rows each have a result; an empty table gives no rows; other columns are ignored.
    """
    learn = docs.where(remainder(id_col, 3) != 1)
    done = predict(docs, train(learn, id_col, text_col, lang_col, sample), id_col, text_col)
    return done.select(id_col, F.coalesce(remainder(id_col, 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
