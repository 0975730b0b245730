"""Text functions as column expressions: tokens, fields of a résumé, redaction, blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern, and words that don't count as search terms.
TOKEN = r"\b[a-z0-9]+(?:\.[a-z0-9]+)*(?:\+\+|#)?\b|[a-z0-9]+-[a-z0-9]+"
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that",
    "the", "to", "was", "were", "will", "with", "experience", "responsible", "working", "knowledge", "years", "team", "using",
)
#: Patterns and defaults of the fields.
NOT_A_NAME = r"(?i)(@|http|www|phone|resume|curriculum)"
ROLES = ("engineer", "developer", "architect", "designer", "manager", "lead", "scientist", "analyst", "consultant", "intern")
EMAIL, NO_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "contact@candidate.io"
PHONE, NO_PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "(555) 019-2834"
LINKEDIN = r"(?i)(?:https?:\/\/)?(?:www\.)?linkedin\.com\/in\/([a-zA-Z0-9_-]+)"
PLACES = (
    r"([A-Z][a-zA-Z\s]+,\s*[A-Z]{2}(?:\s+\d{5})?)",
    r"([A-Z][a-zA-Z\s]+,\s*(?:USA|United States|UK|United Kingdom|India|Canada|Germany|Remote))",
)
NO_PLACE, NOT_A_PLACE = "San Francisco, CA", ("university", "college", "company", "inc", "llc")
DEGREES = (
    r"(?i)((?:Master of Science|Master of Engineering|Bachelor of Science|Bachelor of Engineering|Bachelor of Technology|B\.S\.|M\.S\.|B\.Tech|M\.Tech|Ph\.D\.|PhD|Bachelor|Master)[^\n,\.]{0,60}(?:University|College|Institute|School)?[^\n]{0,40})",
    r"(?i)((?:Stanford|MIT|UC Berkeley|Carnegie Mellon|Harvard|University|College)[^\n]{0,60})",
)
NO_DEGREE = "B.S. in Computer Science"
PERIOD = r"(20\d{2}|19\d{2})\s*(?:—|-|to)\s*(20\d{2}|Present|Current|present|current)"
YEAR = r"\b(20\d{2}|19\d{2})\b"
#: Skills looked for, in this order, and those taken where none is found.
SKILLS = (
    "Python", "JavaScript", "TypeScript", "Go", "Golang", "Rust", "Java", "C++", "C#", "C", "Ruby", "PHP", "Swift", "Kotlin", "Scala", "SQL", "HTML", "CSS", "Bash", "Shell",
    "FastAPI", "Django", "Flask", "React", "Next.js", "Vue.js", "Angular", "Node.js", "Express", "NestJS", "Spring", "Spring Boot", "Tailwind CSS", "Bootstrap", "Redux", "GraphQL", "REST APIs", "gRPC",
    "PostgreSQL", "MySQL", "MongoDB", "Redis", "Elasticsearch", "Cassandra", "DynamoDB", "SQLite", "Snowflake", "BigQuery", "Neo4j", "pgvector", "Vector DB",
    "AWS", "Amazon Web Services", "GCP", "Google Cloud", "Azure", "Docker", "Kubernetes", "K8s", "Terraform", "CI/CD", "GitHub Actions", "GitLab CI", "Jenkins", "Ansible", "Linux", "Nginx", "Kafka", "RabbitMQ", "Celery",
    "Machine Learning", "Deep Learning", "PyTorch", "TensorFlow", "scikit-learn", "Pandas", "NumPy", "Apache Spark", "Airflow", "Hadoop", "LangChain", "LlamaIndex", "HuggingFace", "NLP", "Computer Vision", "LLM",
    "Git", "GitHub", "GitLab", "Jira", "Agile", "Scrum", "Microservices", "System Design", "Distributed Systems", "TDD", "Unit Testing", "Figma", "UI/UX", "User Research",
)
NO_SKILLS = ("Python", "FastAPI", "PostgreSQL", "Docker", "Git", "TypeScript")


def tokens(text: Column) -> Column:
    """Search terms: matches of TOKEN in the lower-cased text that are longer than one character and no stopword."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def lines(text: Column) -> Column:
    """Trimmed lines that have something in them."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def name(text: Column) -> Column:
    """The first line if it is short and looks like a name, else a short second one."""
    own = lines(text)
    first, second = F.get(own, F.lit(0)), F.get(own, F.lit(1))
    return F.coalesce(F.when((F.length(first) < 50) & ~first.rlike(NOT_A_NAME), first), F.when(F.length(second) < 50, second), F.lit("Candidate"))


def headline(text: Column) -> Column:
    """Of lines 2 to 5 the first short one that names a role."""
    role = lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(r) for r in ROLES])
    found = F.filter(F.slice(lines(text), 2, 4), lambda x: role(x) & (F.length(x) < 80) & ~x.contains("@"))
    return F.coalesce(F.get(found, F.lit(0)), F.lit("Software Engineer"))


def email(text: Column) -> Column:
    return F.coalesce(_first_match(text, EMAIL), F.lit(NO_EMAIL))


def phone(text: Column) -> Column:
    return F.coalesce(_first_match(text, PHONE), F.lit(NO_PHONE))


def linkedin(text: Column, person: Column) -> Column:
    return F.concat(F.lit("linkedin.com/in/"), F.coalesce(_first_match(text, LINKEDIN, 1), F.replace(F.lower(person), F.lit(" "), F.lit(""))))


def location(text: Column) -> Column:
    """The first match of each pattern in turn, if it is short and no organisation."""

    def sound(x: Column) -> Column:
        return F.when((F.length(x) < 40) & ~reduce(lambda a, b: a | b, [F.lower(x).contains(w) for w in NOT_A_PLACE]), x)

    return F.coalesce(*[sound(F.regexp_replace(_first_match(text, p, 1), r"^\s+|\s+$", "")) for p in PLACES], F.lit(NO_PLACE))


def skill_pattern(skill: str) -> str:
    """The skill as a whole word, whatever its case."""
    return r"(?i)\b" + "".join(c if c.isalnum() or c == "_" else "\\" + c for c in skill) + r"\b"


def found_skills(text: Column) -> Column:
    """Skills of the catalogue that the text names, in the catalogue's order (none: empty).

    A skill is looked for as a word only where its letters stand in the text at all.
    """
    lowered = lambda t: F.lower(t)
    named = lambda t, low: F.array_compact(F.array(*[F.when(low.contains(s.lower()) & t.rlike(skill_pattern(s)), F.lit(s)) for s in SKILLS]))
    return F.transform(F.array(F.struct(text.alias("t"), lowered(text).alias("low"))), lambda x: named(x["t"], x["low"]))[0]


def skills(text: Column) -> Column:
    """found_skills(), or the default ones. The array is bound once, so that both branches see the same evaluation."""
    return F.transform(F.array(found_skills(text)), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, NO_SKILLS))))[0]


def education(text: Column) -> Column:
    def sound(x: Column) -> Column:
        return F.when((F.length(x) > 5) & (F.length(x) < 100), x)

    return F.coalesce(*[sound(F.regexp_replace(_first_match(text, p, 1), r"^\s+|\s+$", "")) for p in DEGREES], F.lit(NO_DEGREE))


def years(text: Column) -> Column:
    """All four-digit years in the text."""
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def years_of_experience(text: Column, now: int = 2026) -> Column:
    """Years since the earliest one named, if that is plausible, else four."""
    earliest = F.array_min(years(text))
    return F.when(earliest.between(1990, now) & (F.lit(now) - earliest).between(1, 30), (F.lit(now) - earliest).cast("double")).otherwise(4.0)


def periods(text: Column) -> Column:
    """Year ranges, as they are written."""
    return F.regexp_extract_all(text, F.lit(PERIOD), F.lit(0))


def initials(person: Column, most: int | None = 2, default: str = "CA") -> Column:
    """First letters of the (first few) words, upper case."""
    words = F.filter(F.split(person, r"\s+"), lambda w: w != "")
    words = F.slice(words, 1, most) if most else words
    return F.coalesce(F.nullif(F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")), F.lit("")), F.lit(default))


def pseudonym(person: Column) -> Column:
    return F.concat(F.lit("Candidate #"), (F.pmod(F.xxhash64(person), F.lit(9000)) + 1000).cast("string"))


def redact(text: Column) -> Column:
    """Addresses and telephone numbers replaced by their kind; blank text becomes empty."""
    out = F.regexp_replace(F.regexp_replace(text, EMAIL, "[EMAIL_ADDRESS]"), PHONE, "[PHONE_NUMBER]")
    return F.when(F.trim(text) == "", F.lit("")).otherwise(out)


def short_id(prefix: str, key: Column, n: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(key.cast("string")), 1, n))


def html_text(html: Column) -> Column:
    """A page's text: scripts and styles out, tags to spaces, white space to single spaces."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"\s+", " "))
