"""Model calls as pluggable Arrow functions, with deterministic stand-ins that need no network.

Each takes a loader, a function without arguments that is called once a worker; the real model goes behind it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.functions import text as T

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
_TOKEN, _STOP = re.compile(T.TOKEN), frozenset(T.STOPWORDS)


def terms(text: str) -> list[str]:
    """Search terms of one text, as functions.text.tokens() has them."""
    return [t for t in _TOKEN.findall(text.lower()) if len(t) > 1 and t not in _STOP]


@lru_cache(maxsize=1 << 16)
def _hashed(term: str) -> int:
    """FNV-1a of 64 bits; kept for the terms that come often."""
    h = 14695981039346656037
    for byte in term.encode():
        h = (h ^ byte) * 1099511628211 % (1 << 64)
    return h


class HashingEmbedder:
    """Signed feature hashing of terms to unit vectors; the same on every machine."""

    dimension = 384

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for term in terms(text):
                h = _hashed(term)
                row[h % self.dimension] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return list(out / np.where(size == 0, 1, size))


def embed(df: DataFrame, load: Callable, column: str, prefix: str = "", batch: int = 256) -> DataFrame:
    """df with `vector`; null texts count as empty."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = [prefix + (x or "") for x in part]
            yield pd.Series([v for k in range(0, len(texts), batch) for v in model(texts[k : k + batch])], dtype=object)

    return df.withColumn("vector", run(column))


def overlap_scorer() -> Callable[[list[tuple[str, str]]], list[float]]:
    """The stand-in for a cross-encoder: the share of the query's terms that the passage has, from -4 to 4."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, passage in pairs:
            wanted = set(terms(query or ""))
            out.append(len(wanted & set(terms(passage or ""))) / len(wanted) * 8.0 - 4.0 if wanted else -4.0)
        return out

    return score


def anonymise(df: DataFrame, column: str, people: Column) -> DataFrame:
    """df with `anonymised`: people (an array of names; the recogniser's part), addresses and telephone numbers replaced."""
    hidden = F.aggregate(people, F.col(column), lambda t, p: F.replace(t, p, F.lit("[CANDIDATE_NAME]")))
    return df.withColumn("anonymised", T.redact(hidden))


def parse_profiles(df: DataFrame, column: str) -> DataFrame:
    """df with `parsed` (did the answer parse?) and the parsed fields; a bad answer keeps its row."""
    schema = "company_name string, title string, year int, overall double, _bad string"
    p = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return df.withColumn("_p", p).select("*", F.col("_p._bad").isNull().alias("parsed"), F.col("_p.overall").alias("overall")).drop("_p")


def rule_evaluator() -> Callable[[str], float]:
    """The stand-in for an evaluation: seniority words decide; no profile raises."""

    def score(profile: str) -> float:
        if profile is None:
            raise ValueError("no answer")
        return 88.0 if "Staff" in profile or "Senior" in profile else 45.0

    return score


def evaluate(df: DataFrame, load: Callable, column: str = "profile") -> DataFrame:
    """df with success, score, error: a failure is a row's result, not the job's."""

    @F.pandas_udf("success boolean, score double, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            rows = []
            for profile in part:
                try:
                    rows.append((True, float(model(profile)), None))
                except Exception as e:  # noqa: BLE001  a model's error is an answer here
                    rows.append((False, None, str(e)))
            yield pd.DataFrame(rows, columns=["success", "score", "error"]).astype({"score": "float64"})

    return df.withColumn("_r", run(column)).select("*", "_r.*").drop("_r")


def html_decoder() -> Callable[[str], str]:
    """The stand-in for a page decoder: a page's text without scripts, styles and tags."""
    skip, tag, space = re.compile(r"<(script|style)\b.*?</(script|style)>", re.I | re.S), re.compile(r"<[^>]*>"), re.compile(r"\s+")
    return lambda html: space.sub(" ", tag.sub(" ", skip.sub(" ", html))).strip()


def decode(df: DataFrame, load: Callable, column: str) -> DataFrame:
    """df with `decoded`, null where there is nothing to decode."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            yield part.map(lambda x: None if x is None else model(x))

    return df.withColumn("decoded", run(column))
