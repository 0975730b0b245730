"""Experience items of a résumé as column expressions: a window of text around each period, and what its lines say."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylane.functions.text import PERIOD

#: Words by which a line is taken for a role or a company; what stands where nothing is found; how many
#: periods count where the caller doesn't say, how far around them is looked, and how long lines are; sentences made of skills.
ROLE_WORDS = ("engineer", "developer", "architect", "lead", "manager", "designer", "scientist", "analyst")
COMPANY_WORDS = ("inc", "corp", "technologies", "labs", "systems", "google", "meta", "amazon", "stripe", "uber", "apple", "microsoft", "co", "ltd")
NO_COMPANY, CORE_COMPANY, NOW = "Technology Solutions", "Core Platform Engineering", "2022 — Present"
MOST, BEFORE, BEHIND, SHORT, LONG, SHOWN = 3, 100, 200, 60, 30, 150
#: Characters of the shortest period, such as 2001-2003.
SHORTEST = 9
CONTRIBUTED = ("Contributed to core development and platform engineering utilizing ", 3)
LED = ("Led development of scalable services and cloud infrastructure with ", 4)


def _sentence(start: tuple[str, int], skills: Column) -> Column:
    return F.concat(F.lit(start[0]), F.array_join(F.slice(skills, 1, start[1]), ", "), F.lit("."))


def _has(line: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(line).contains(w) for w in words])


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once, however often it is used, also for each element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def windows(text: Column, most: int | None = MOST) -> Column:
    """For the first periods of a text (None: all): the period, and the text from BEFORE characters before it to BEHIND behind it.

    A window is put together from the few periods that it has room for and what stands between them, so that a text with many
    periods takes no longer than its length asks for.
    """
    periods = F.regexp_extract_all(text, F.lit(PERIOD), F.lit(0))
    between = F.split(text, PERIOD, most + 1 if most is not None else -1)  # what stands before each of them, and the rest
    found = F.struct((F.slice(periods, 1, most) if most is not None else periods).alias("periods"), between.alias("between"))
    before, behind = BEFORE // SHORTEST + 1, BEHIND // SHORTEST + 1

    def cut(x: Column) -> Column:
        """Each period after what of the text before it a window can have, and before what it can have of the text behind."""
        upto = F.transform(x["periods"], lambda p, i: F.concat(F.right(F.get(x["between"], i), F.lit(BEFORE)), p))
        since = F.transform(x["periods"], lambda p, i: F.concat(p, F.left(F.get(x["between"], i + 1), F.lit(BEHIND))))
        return F.struct(x["periods"].alias("periods"), upto.alias("upto"), since.alias("since"))

    def near(x: Column, p: Column, i: Column) -> Column:
        first = F.greatest(i - before, F.lit(0))
        upto = F.right(F.array_join(F.slice(x["upto"], first + 1, i - first + 1), ""), F.length(p) + BEFORE)
        since = F.array_join(F.slice(x["since"], i + 1, F.lit(behind + 1)), "")
        return F.concat(upto, F.substring(since, F.length(p) + 1, F.lit(BEHIND)))

    made = lambda x: F.transform(x["periods"], lambda p, i: F.struct(p.alias("period"), near(x, p, i).alias("near")))
    return _bound(found, lambda x: _bound(cut(x), made))


def item(window: Column, headline: Column, skills: Column) -> Column:
    """What the lines of a window say: the last that names a role, the last other that names a company, the first long one."""
    lines = F.filter(F.transform(F.split(window["near"], "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    none = F.struct(*[F.lit(None).cast("string").alias(x) for x in ("role", "company", "told")])

    def read(done: Column, x: Column) -> Column:
        """The lines one after the other, each looked at once."""
        short, role = F.length(x) < SHORT, _has(x, ROLE_WORDS)
        return F.struct(
            F.when(short & role, x).otherwise(done["role"]).alias("role"), F.when(short & ~role & _has(x, COMPANY_WORDS), x).otherwise(done["company"]).alias("company"),
            F.when(done["told"].isNull() & (F.length(x) > LONG) & ~x.startswith("20") & ~x.contains("@"), x).otherwise(done["told"]).alias("told"),
        )

    said = lambda s: F.struct(
        F.coalesce(s["role"], headline).alias("role"), F.coalesce(s["company"], F.lit(NO_COMPANY)).alias("company"), window["period"].alias("period"),
        F.coalesce(F.concat(F.substring(s["told"], 1, SHOWN), F.lit("...")), _sentence(CONTRIBUTED, skills)).alias("description"),
    )
    return F.aggregate(lines, none, read, said)


def experience(text: Column, headline: Column, skills: Column, most: int | None = MOST) -> Column:
    """Items (role, company, period, description) by the first year ranges (None: by all); one made of headline and skills without any.

    A null text counts as empty.
    """

    def items(x: Column) -> Column:
        made = F.struct(x["headline"].alias("role"), F.lit(CORE_COMPANY).alias("company"), F.lit(NOW).alias("period"), _sentence(LED, x["skills"]).alias("description"))
        return F.when(F.size(x["found"]) > 0, F.transform(x["found"], lambda w: item(w, x["headline"], x["skills"]))).otherwise(F.array(made))

    return _bound(F.struct(windows(F.coalesce(text, F.lit("")), most).alias("found"), headline.alias("headline"), skills.alias("skills")), items)
