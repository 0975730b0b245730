"""The whole profile from a model's answer: one JSON text, whatever its keys and shapes, as the struct of schemas.profile()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylane.functions import coercion
from quarrylane.sources import schemas

OBJECTS, OBJECT, TEXTS = "array<map<string,string>>", "map<string,string>", "array<string>"
#: The keys of a taxonomy of skills, and what stands where an answer says nothing.
TAXONOMY = ("core_languages", "frameworks_and_tools", "databases_and_infrastructure", "detailed_skills")
NO_NAME, NO_HEADLINE, NO_SKILL, NO_TOOL = "[CANDIDATE_NAME]", "Software Professional", "Unknown", "Tooling & Platforms"
NO_COMPANY, NO_TITLE, NO_START, NO_END, NO_PLACE, NO_LEVEL = "Unknown Company", "Engineer", "Unknown", "Present", "Unknown", "Intermediate"
NO_INSTITUTION, NO_DEGREE, NO_SUBJECT = "Unknown Institution", "Degree / Certificate", "Computer Science / General"
NO_CERTIFICATION, NO_ISSUER, NO_PROJECT, ENGINE, VERSION = "Certification", "Certifying Body", "Project", "hybrid-pymupdf-docling", "1.0.0"


def _pick(m: Column, field: str, otherwise: str | None = None) -> Column:
    """The first of the field's keys that a parsed object has."""
    return F.coalesce(*[m[key] for key in coercion.ALIASES[field]], F.lit(otherwise))


def _list(json: Column, kind: str) -> Column:
    """A JSON list parsed; nothing, or no list, is an empty one."""
    return F.coalesce(F.when(F.trim(json).startswith("["), F.from_json(json, kind)), F.array().cast(kind))


def _bind(value: Column, what) -> Column:
    """what(value), with value evaluated once."""
    return F.transform(F.array(value), what)[0]


def _position(m: Column) -> Column:
    return F.struct(
        _pick(m, "company_name", NO_COMPANY), _pick(m, "job_title", NO_TITLE), F.coalesce(coercion.category(_pick(m, "workplace_type"), coercion.WORKPLACE), F.lit(NO_PLACE)),
        _pick(m, "start_date", NO_START), _pick(m, "end_date", NO_END), F.coalesce(_pick(m, "is_current_role").try_cast("boolean"), F.lit(False)),
        _pick(m, "duration_months").try_cast("int"), *[_list(_pick(m, f), TEXTS) for f in ("primary_technologies", "responsibilities", "quantified_achievements")],
    )


def _gap(m: Column) -> Column:
    return F.struct(m["start_date"], m["end_date"], F.coalesce(m["gap_duration_months"].try_cast("int"), F.lit(3)), m["inferred_reason"])


def _timeline(json: Column) -> Column:
    def built(m):
        longest, average = m["longest_tenure_months"].try_cast("int"), m["average_tenure_months"].try_cast("double")
        years = F.coalesce(_pick(m, "total_continuous_years").try_cast("double"), F.lit(0.0))
        return F.struct(years, F.transform(_list(_pick(m, "positions"), OBJECTS), _position), F.transform(_list(_pick(m, "career_gaps"), OBJECTS), _gap), longest, average)

    return _bind(F.coalesce(F.from_json(coercion.as_list(json, "positions"), OBJECT), F.create_map().cast(OBJECT)), built)


def _skill(item: Column) -> Column:
    """A skill from the JSON text of an object, or from a bare name."""
    parsed = F.when(F.trim(item).startswith("{"), F.from_json(item, OBJECT)).otherwise(F.create_map(F.lit("name"), item))

    def built(m):
        level = F.coalesce(coercion.category(_pick(m, "proficiency"), coercion.PROFICIENCY), F.lit(NO_LEVEL))
        years, core = m["estimated_years_experience"].try_cast("double"), F.coalesce(m["is_core_competency"].try_cast("boolean"), F.lit(False))
        kind = F.coalesce(coercion.skill_category(m["category"]), F.lit(NO_TOOL))
        return F.struct(_pick(m, "skill_name", NO_SKILL), kind, level, years, core, _pick(m, "context_evidence"))

    return _bind(parsed, built)


def _skills(json: Column) -> Column:
    """A taxonomy, a list of skills, or an object of lists under keys that aren't known: all become a taxonomy."""

    def built(m):
        known = F.exists(F.map_keys(m), lambda k: k.isin(*TAXONOMY))
        loose = F.flatten(F.transform(F.map_values(m), lambda v: _list(v, TEXTS)))
        every = F.when(F.trim(json).startswith("["), _list(json, TEXTS)).when(known, _list(m["detailed_skills"], TEXTS)).otherwise(loose)
        return F.struct(*[_list(m[k], TEXTS) for k in TAXONOMY[:3]], F.transform(every, _skill))

    return _bind(F.coalesce(F.when(F.trim(json).startswith("{"), F.from_json(json, OBJECT)), F.create_map().cast(OBJECT)), built)


def _education(m: Column) -> Column:
    return F.struct(
        _pick(m, "institution", NO_INSTITUTION), _pick(m, "degree", NO_DEGREE), _pick(m, "field_of_study", NO_SUBJECT), _pick(m, "graduation_year"), _pick(m, "grade_or_gpa")
    )


def _certification(m: Column) -> Column:
    rest = [_pick(m, f) for f in ("issue_date", "expiration_date", "credential_id_or_url")]
    return F.struct(_pick(m, "certification", NO_CERTIFICATION), _pick(m, "issuing_organization", NO_ISSUER), *rest)


def _project(m: Column) -> Column:
    return F.struct(_pick(m, "project_name", NO_PROJECT), _pick(m, "description", ""), _list(_pick(m, "technologies_used"), TEXTS), _pick(m, "impact_or_metrics"))


def profile(doc: Column) -> Column:
    """The profile that a JSON object holds, in the shape of schemas.profile(); null where doc is null or no JSON object.

    Fields come under any of their aliases; lists and objects are taken in each shape that models give. What is missing,
    or can't be read as its type, gets the field's default: null, an empty list, or the fixed values above. Without an
    identifier `candidate_id` is one made from the text, so that a repeated run gives the same.
    """

    def built(m):
        lists = [F.transform(_list(m[k], OBJECTS), f) for k, f in (("education", _education), ("certifications", _certification), ("notable_projects", _project))]
        made = F.regexp_replace(F.md5(doc), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
        return F.struct(
            F.coalesce(_pick(m, "candidate_id"), made), _pick(m, "anonymized_name", NO_NAME), _pick(m, "target_role_or_headline", NO_HEADLINE),
            _pick(m, "executive_summary", ""), _timeline(m["timeline"]), _skills(m["skills"]), *lists,
            F.coalesce(m["parsing_engine"], F.lit(ENGINE)), F.coalesce(m["schema_version"], F.lit(VERSION)),
        )

    parsed = F.when(F.json_object_keys(doc).isNotNull(), F.from_json(doc, OBJECT))
    return F.when(parsed.isNotNull(), _bind(parsed, built).cast(schemas.profile()))
