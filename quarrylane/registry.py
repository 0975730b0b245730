"""All queries of the engine outside the llm subpackage, with their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylane.sources import entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; `uses` names the entities whose definitions its oracle SQL needs in front."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            heads = [f"{x} AS ({entities.duck(x)})" for x in uses]
            body = sql.strip()
            if heads:
                body = f"WITH {', '.join(heads)}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"
            ORACLES[name] = body
        return function

    return add


for _module in ("sources", "filters", "projections", "joins", "aggregates", "ranking", "text", "numeric", "coercion", "retrieval", "terms", "mutations", "streams", "indexes"):
    importlib.import_module(f"quarrylane.queries.{_module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: BM25 and vectors fused by reciprocal ranks."""
    return QUERIES["dml07_hybrid_search"](spark, sf_dir)
