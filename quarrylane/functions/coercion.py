"""Normalising loosely structured model output: aliases, categories, numbers, shapes, identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS namespace of version 5 UUIDs, as hexadecimal digits.
DNS = uuid.NAMESPACE_DNS.hex

#: For each field, the keys under which it may come, best first.
ALIASES = {
    "company_name": ("company_name", "company", "employer", "organization"),
    "job_title": ("job_title", "title", "role", "position"),
    "start_date": ("start_date", "start", "from"),
    "end_date": ("end_date", "end", "to"),
    "graduation_year": ("graduation_year", "year_of_completion", "year", "date", "graduation_date", "years"),
    "institution": ("institution", "university", "college", "school", "bootcamp", "name"),
    "degree": ("degree", "degree_level", "qualification", "title"),
    "field_of_study": ("field_of_study", "major", "field", "subject", "study_area"),
    "grade_or_gpa": ("grade_or_gpa", "gpa", "grade", "honors"),
    "certification": ("name", "certification_name", "title", "cert_name"),
    "issuing_organization": ("issuing_organization", "issuer", "organization", "issuing_body", "company"),
    "issue_date": ("issue_date", "date_obtained", "date", "issued"),
    "expiration_date": ("expiration_date", "expires"),
    "credential_id_or_url": ("credential_id_or_url", "credential_id", "url", "verification_url"),
    "project_name": ("project_name", "name", "title"),
    "description": ("description", "summary", "details"),
    "technologies_used": ("technologies_used", "technologies", "tech_stack", "tools"),
    "impact_or_metrics": ("impact_or_metrics", "impact", "metrics", "results"),
    "candidate_id": ("candidate_id", "id"),
    "anonymized_name": ("anonymized_name", "name"),
    "target_role_or_headline": ("target_role_or_headline", "headline", "title", "target_role"),
    "executive_summary": ("executive_summary", "summary", "profile_summary", "about"),
    "is_current_role": ("is_current_role", "current", "is_current"),
    "duration_months": ("duration_months", "duration"),
    "primary_technologies": ("primary_technologies", "technologies", "tech_stack", "skills"),
    "responsibilities": ("responsibilities", "duties"),
    "quantified_achievements": ("quantified_achievements", "achievements", "highlights", "impact"),
    "workplace_type": ("workplace_type", "location_type", "type"),
    "total_continuous_years": ("total_continuous_years", "total_years", "years_of_experience", "total_experience_years"),
    "positions": ("positions", "experiences", "work_history", "jobs"),
    "career_gaps": ("career_gaps", "gaps"),
    "skill_name": ("name", "skill", "skill_name", "title"),
    "proficiency": ("proficiency", "level", "proficiency_level"),
    "context_evidence": ("context_evidence", "evidence", "details"),
}
#: Categories, and the words by which free text is taken for one (first match; else the last column).
SKILL_CATEGORIES = (
    "Programming Language", "Framework / Library", "Database / Storage", "Cloud & DevOps", "AI / ML / Data Engineering",
    "Architecture & Systems", "Security & Compliance", "Tooling & Platforms", "Domain Knowledge", "Soft Skill",
)
PROFICIENCY = ((("exp", "lead"), "Expert"), (("adv", "sr"), "Advanced"), (("beg", "jun"), "Beginner"), ((), "Intermediate"))
WORKPLACE = ((("remote",), "Remote"), (("hybrid",), "Hybrid"), (("onsite", "on-site", "office"), "On-site"), ((), "Unknown"))
CRITERION = (
    (("tech", "stack", "skill"), "Tech Stack Alignment"), (("exp", "senior", "year"), "Experience & Seniority Level"),
    (("arch", "system", "design"), "Architecture & Systems Depth"), (("impact", "quant", "metric"), "Quantified Impact & Scope"),
    (("domain", "indus", "know"), "Domain / Industry Knowledge"), ((), "Tech Stack Alignment"),
)
QUESTION = (
    (("tech", "code"), "Technical Deep Dive"), (("arch", "sys", "design"), "Architecture & System Design"), (("gap", "risk"), "Gap / Risk Verification"),
    (("behav", "lead"), "Behavioral & Leadership"), ((), "Technical Deep Dive"),
)
TIER = ((("strong", "high"), "Strong Fit"), (("low", "poor", "reject"), "Low Match"), ((), "Potential Fit"))


def alias(doc: Column, field: str) -> Column:
    """The first of the field's keys that a JSON document has."""
    return F.coalesce(*[F.get_json_object(doc, f"$.{key}") for key in ALIASES[field]])


def category(value: Column, rules) -> Column:
    """A category: itself if it is one, else by the first rule with a word that the value has."""
    low = F.lower(value)
    out = F.when(value.isNull() | (value == ""), value).when(value.isin(*[name for _, name in rules]), value)
    for words, name in rules:
        hit = F.lit(True)
        if words:
            hit = F.lit(False)
            for word in words:
                hit = hit | low.contains(word)
        out = out.when(hit, name)
    return out


def skill_category(value: Column) -> Column:
    return F.when(value.isin(*SKILL_CATEGORIES), value).otherwise("Tooling & Platforms")


def score_1_to_5(value: Column) -> Column:
    """Whole numbers are clamped, fractions cut first if they are numbers (text of one counts as none): else 3."""
    whole = value.try_cast("int")
    return F.when(value.isNull(), None).when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.greatest(F.lit(1), F.least(F.lit(5), whole))).otherwise(3)


def score_0_to_100(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(value.isNull(), None).when(number.isNull(), 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)))


def as_list(doc: Column, field: str) -> Column:
    """A bare list is wrapped as the object {field: list}."""
    return F.when(F.trim(doc).startswith("["), F.concat(F.lit(f'{{"{field}": '), doc, F.lit("}"))).otherwise(doc)


def stable_uuid(value: Column) -> Column:
    """A UUID as it is, other text by version 5 in the DNS namespace, null for nothing."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "urn:|uuid:", ""), "^[{}]+|[{}]+$", ""), "-", ""))
    named = F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(value, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(named, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    named = F.concat(F.substring(named, 1, 12), F.lit("5"), F.substring(named, 14, 3), variant, F.substring(named, 18, 15))
    digits = F.when(plain.rlike("^[0-9a-f]{32}$"), plain).otherwise(named)
    return F.when(value != "", F.concat_ws("-", *[F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
