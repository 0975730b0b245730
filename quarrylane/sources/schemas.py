"""Schemas of the engine's records and tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

PROFILE_DDL = """
candidate_id string, anonymized_name string, target_role_or_headline string, executive_summary string,
timeline struct<total_continuous_years: double,
  positions: array<struct<company_name: string, job_title: string, workplace_type: string, start_date: string, end_date: string,
    is_current_role: boolean, duration_months: int, primary_technologies: array<string>, responsibilities: array<string>, quantified_achievements: array<string>>>,
  career_gaps: array<struct<start_date: string, end_date: string, gap_duration_months: int, inferred_reason: string>>,
  longest_tenure_months: int, average_tenure_months: double>,
skills struct<core_languages: array<string>, frameworks_and_tools: array<string>, databases_and_infrastructure: array<string>,
  detailed_skills: array<struct<name: string, category: string, proficiency: string, estimated_years_experience: double, is_core_competency: boolean, context_evidence: string>>>,
education array<struct<institution: string, degree: string, field_of_study: string, graduation_year: string, grade_or_gpa: string>>,
certifications array<struct<name: string, issuing_organization: string, issue_date: string, expiration_date: string, credential_id_or_url: string>>,
notable_projects array<struct<project_name: string, description: string, technologies_used: array<string>, impact_or_metrics: string>>,
parsing_engine string, schema_version string"""

TABLES_DDL = {
    "candidates": "id string, anonymized_name string, target_headline string, years_of_experience decimal(4,1), location string, highest_education string, core_skills array<string>, raw_anonymized_text string, structured_profile string, parsing_engine string, embedding array<float>, created_at timestamp, updated_at timestamp",
    "job_postings": "id string, title string, department string, location string, job_description string, min_years_experience decimal(4,1), required_skills array<string>, status string, structured_criteria string, embedding array<float>, created_at timestamp, updated_at timestamp",
    "applications": "id string, candidate_id string, job_id string, status string, stage string, current_match_score decimal(5,2), applied_at timestamp, updated_at timestamp",
    "scoring_audits": "id string, application_id string, candidate_id string, job_id string, overall_match_score decimal(5,2), qualification_tier string, criteria_breakdown string, pros array<string>, cons_or_risks array<string>, recommended_interview_questions array<string>, recruiter_summary string, llm_model string, prompt_tokens int, completion_tokens int, latency_ms int, raw_prompt string, raw_llm_response string, evaluated_at timestamp",
}


def profile() -> StructType:
    """A profile's schema; needs an active session, as all parsing of DDL does."""
    return StructType.fromDDL(PROFILE_DDL)


def table_schema(name: str) -> StructType:
    """A table's schema."""
    return StructType.fromDDL(TABLES_DDL[name])


def provision(spark: SparkSession, database: str | None = None) -> list[str]:
    """Create the tables that aren't there yet, as Parquet in the session's warehouse; returns their names."""
    prefix = f"{database}." if database else ""
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, ddl in TABLES_DDL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({ddl}) USING parquet")
    return [f"{prefix}{name}" for name in TABLES_DDL]
