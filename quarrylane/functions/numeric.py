"""Numeric functions as column expressions: similarity, fusion, BM25, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Zero where either vector is zero."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def rrf_term(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (rank + k)


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def bm25_weight(idf: Column, tf: Column, length: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def match_score(n_skills: Column) -> Column:
    return F.least(F.lit(98), F.greatest(F.lit(75), 80 + n_skills * 2))


def match_tier(score: Column) -> Column:
    return F.when(score >= 92, "Exceptional Match").when(score >= 85, "Strong Match").otherwise("Potential Fit")


def technical_depth(n_skills: Column) -> Column:
    return F.round(F.least(F.lit(10.0), 7.5 + n_skills * 0.2), 1)


def system_design(years: Column) -> Column:
    return F.round(F.least(F.lit(10.0), 7.0 + years * 0.3), 1)


def tier_of_score(score: Column) -> Column:
    return F.when(score >= 80, "Strong Fit").when(score >= 60, "Potential Fit").otherwise("Low Match")


def rule_score(profile: Column) -> Column:
    """The offline evaluator: seniority words decide."""
    return F.when(profile.contains("Staff") | profile.contains("Senior"), 88.0).otherwise(45.0)


def backoff(attempt: Column, most: float = 300.0) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(most))


def weighted_score(scores: Column, weights: Column) -> Column:
    """Out of 100: the scores (of five each) by their weights."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return total(F.zip_with(scores, weights, lambda s, w: s * w)) / (total(weights) * 5) * 100
