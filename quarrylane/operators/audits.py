"""Evaluation reports as rows of the audit ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.functions.numeric import tier_of_score


def audit_rows(reports: DataFrame, model: str = "rules", latency_ms: int = 0, raw_prompt: str = "") -> DataFrame:
    """Reports (overall_match_score, suggested_interview_questions, ...) as ledger rows; questions are reduced to their text."""
    out = reports.withColumn("recommended_interview_questions", F.transform("suggested_interview_questions", lambda q: q["question"])).drop("suggested_interview_questions")
    if "qualification_tier" not in reports.columns:
        out = out.withColumn("qualification_tier", tier_of_score(F.col("overall_match_score")))
    return out.withColumns({"llm_model": F.lit(model), "latency_ms": F.lit(latency_ms), "raw_prompt": F.lit(raw_prompt)})


def append_audit(rows: DataFrame, path: str, day: str = "evaluated_on") -> None:
    """Append ledger rows, one folder a day; nothing is ever changed there."""
    rows.write.mode("append").partitionBy(day).parquet(path)
