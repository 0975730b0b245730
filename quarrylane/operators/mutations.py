"""Changes as plans: keyed upsert, stage and status updates, notes, jobs, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.functions.text import initials, short_id

#: Words that become a new job's skills, and those taken where none is there.
KEYWORDS = ("Python", "FastAPI", "PostgreSQL", "Kubernetes", "AWS", "React", "TypeScript", "Docker")
NO_KEYWORDS = ("Python", "FastAPI", "PostgreSQL")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with each of changes' rows in place of that with its key, or added."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def update_stage(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Stage and status from changes (key, stage) where it has the row; unknown keys change nothing."""
    c = changes.select(F.col(key), F.col("stage").alias("_stage"))
    return base.join(c, key, "left").withColumns({"stage": F.coalesce("_stage", "stage"), "status": F.coalesce("_stage", "status")}).drop("_stage")


def update_job_status(jobs: DataFrame, new_status: Column) -> DataFrame:
    """New status; PAUSED pauses the match, OPEN resumes it and keeps its label, CLOSED leaves it."""
    match = F.col("top_match")
    changed = (
        F.when(new_status == "PAUSED", match.withField("status", F.lit("PAUSED")).withField("label", F.lit("Analysis Paused")))
        .when(new_status == "OPEN", match.withField("status", F.lit("ACTIVE"))).otherwise(match)
    )
    return jobs.withColumn("status", new_status).withColumn("top_match", changed)


def skills_or_keywords(skills: Column, description: Column) -> Column:
    """Given skills, else the keywords that the description has, else the default ones."""
    found = F.array_compact(F.array(*[F.when(F.lower(description).contains(k.lower()), F.lit(k)) for k in KEYWORDS]))
    return F.when(F.size(skills) > 0, skills).when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, NO_KEYWORDS)))


def create_jobs(requests: DataFrame, now: Column) -> DataFrame:
    """Requests (id, skills, job_description, ...) as new jobs with defaults and stamps."""
    criteria = F.create_map(F.lit("technical_depth_weight"), F.lit(0.4), F.lit("system_design_weight"), F.lit(0.4), F.lit("leadership_weight"), F.lit(0.2))
    return requests.withColumns({
        "status": F.lit("OPEN"), "candidates_count": F.lit(0), "structured_criteria": criteria, "posted_date": F.date_format(now, "yyyy-MM-dd"),
        "created_at": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "updated_at": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "required_skills": skills_or_keywords(F.col("skills"), F.col("job_description")),
    })


def new_note(author: Column, content: Column, key: Column) -> Column:
    """A note as a struct; its id is made from key, so that a retry makes the same."""
    return F.struct(
        short_id("note-", key, 6).alias("id"), author.alias("author"), initials(author, None, "RA").alias("initials"), F.lit("Recruiter").alias("role"), content.alias("content")
    )


def add_notes(base: DataFrame, notes: DataFrame, key: str = "id") -> DataFrame:
    """base with the notes (key, note) of each row appended to its array `notes`, in the order of their ids."""
    new = notes.groupBy(key).agg(F.array_sort(F.collect_list("note")).alias("_new"))
    return base.join(new, key, "left").withColumn("notes", F.concat("notes", F.coalesce("_new", F.slice("notes", 1, 0)))).drop("_new")


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """children without the rows whose parent is gone."""
    return children.join(gone.select(key), key, "left_anti")


def set_null(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """children with the key nulled where its parent is gone."""
    g = gone.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    return children.join(g, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def touched(df: DataFrame, now: Column) -> DataFrame:
    return df.withColumn("updated_at", now)
