"""Operator 7, personal data, by boosted trees over candidate spans.

Rules find what has a strict form (email, ip, card, phone): these spans always stay. Looser generators propose further
spans, which may overlap: written-out addresses, numbers without their prefix or with other separators. Boosted trees
judge them by form and surroundings. They learn from the spans of all documents: those that a rule confirms are true, as are the same spans rewritten in a loose form in their place. False are those that a test refutes (check digits,
numbers' ranges, the count of digits) and those before which nothing speaks for their kind; loose spans that the
surroundings speak for, and written-out addresses, are left unlabelled. Calibrated thresholds, one for each kind, take
what is precise enough.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm import boosting
from quarrylane.llm.common import SMALL_CHARS, chunks, forget, table

KINDS = ("email", "ip", "card", "phone")
#: The precision asked for, and the least threshold.
PRECISION, LEAST = 0.98, 0.9
#: Examples that examples() shows of a text, about.
PER_DOCUMENT = 64
#: Candidates judged at once, and distinct examples that a task holds.
BATCH = 50_000
#: Parts of one by which held-out scores are told apart, and the greatest score.
STEPS, HIGHEST = 1024, 50

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: The generators' patterns, by kind.
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|[\[(]\s?at\s?[\])])\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z0-9-]{1,63}){1,6}", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,4}(?:[.,][0-9]{1,4}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./-]?[0-9]){8,15}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:\+|00|\()?[0-9](?:[ ()./-]{0,2}[0-9]){8,14}(?![0-9A-Za-z])"),
}
_HINT = re.compile(r"(mail|contact|write)|(ip|host|server|address)|(card|visa|pay|account)|(phone|tel|call|fax|mobile)", re.I)


def luhn(digits: str) -> bool:
    odd, even = (list(map(int, digits[k::-2])) for k in (-1, -2))
    return (sum(odd) + sum(d * 2 - 9 * (d > 4) for d in even)) % 10 == 0


def digits_of(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def octet(part: str) -> bool:
    """Is a run of digits, of any length, at most 255?"""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def confirmed(kind: str, span: str) -> bool:
    """Does a rule's match pass the rule's test?"""
    if kind == "ip":
        return all(octet(x) for x in span.split("."))
    n = digits_of(span)
    return kind == "email" or (14 <= len(n) <= 19 and luhn(n) if kind == "card" else 10 <= len(n) <= 15)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email rule: at each @, the local part reaches back to the last match or other character."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans (kind, start, end), by kind."""
    out = [("email", a, b) for a, b in emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        if kind == "phone" and "+" not in text:
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text) if confirmed(kind, m.group())]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """The generators' spans (kind, start, end); they may overlap each other."""
    out = []
    for kind, pattern in _LOOSE.items():
        if kind == "email":  # only near an @ or a written one
            marks = [m.start() for m in re.finditer(r"@|[\[(]\s?at\s?[\])]", text, re.I)]
            reach = 0
            for at in marks:
                m = pattern.search(text, max(reach, at - 66), at + 600)
                if m and m.start() <= at:
                    out.append((kind, *m.span()))
                    reach = m.end()
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Form and surroundings of a span."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 8]
    n = digits_of(span)
    groups = [len(x) for x in re.findall(r"[0-9]+", span)] or [0]
    hints = [0.0] * 4
    for m in _HINT.finditer(before):
        hints[m.lastindex - 1] = 1.0
    parts = re.split(r"[.,]", span)
    octets = len(parts) == 4 and all(x.isascii() and x.isdigit() and octet(x) for x in parts)
    return [
        *(float(kind == x) for x in KINDS), len(span), len(n), len(n) / len(span), len(groups), max(groups), min(groups),
        float(luhn(n)) if n else 0.0, float(span[0] == "+"), float(span[:2] == "00"), float(span[0] == "("), span.count("@"),
        len(re.findall(r"[\[(]\s?(?:at|dot)\s?[\])]", span, re.I)), span.count("."), span.count("-"), span.count(" "), span.count("/"),
        span.count(":"), span.count(","), float(octets), float(before[-1:].isalnum()), float(before[-1:] in ("", " ", "\n", "(", "\t")),
        float(after[:1].isalnum()), float(after[:1] in ("", " ", "\n", ".", ",", ")")), *hints,
        float(n[:1] in ("3", "4", "5", "6")) if n else 0.0, float(len(set(n)) <= 2),
    ]


def loosened(kind: str, span: str, pick: int) -> str:
    """A confirmed span in a loose form; pick chooses which."""
    n = digits_of(span)
    if kind == "email":
        return (span.replace("@", " (at) "), span.replace("@", " [at] ").replace(".", " [dot] "), span.replace("@", "@ "))[pick % 3]
    if kind == "ip":
        parts = [int(x[-3:]) for x in span.split(".")]
        return (span.replace(".", ","), ":".join(f"{x:x}" for x in (0x2001, 0xDB8, *parts, pick % 65521, 1)), f"fe80:0:0:{parts[0]:x}{parts[1]:02x}::{parts[2]:x}:{parts[3] + 256:x}")[pick % 3]
    if kind == "card":
        return ".".join(n[k : k + 4] for k in range(0, len(n), 4)) if pick % 2 else "/".join(n[k : k + 4] for k in range(0, len(n), 4))
    return ("00" + n, f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}")[pick % 3]


def refuted(kind: str, span: str) -> bool:
    """Does a test say that a loose span can't be of its kind?"""
    n = digits_of(span)
    if kind == "card":
        return not 14 <= len(n) <= 19 or not luhn(n)
    if kind == "ip" and ":" not in span:
        return not all(octet(x) for x in re.split("[.,]", span))
    return kind == "phone" and not 10 <= len(n) <= 15


def spoken_for(text: str, kind: str, start: int, end: int) -> bool:
    """Do the words before a span, or its written-out form, speak for its kind?"""
    own = KINDS.index(kind) + 1
    return any(m.lastindex == own for m in _HINT.finditer(text[max(0, start - 32) : start])) or (kind == "email" and "@" not in text[start:end])


def labelled(text: str) -> Iterator[tuple[str, str, int, int, int]]:
    """All labelled candidates of one text (text, kind, start, end, 1 or 0), then its confirmed spans in a loose form."""
    rules = rule_spans(text)
    true, over = set(rules), Intervals(rules)
    for k, a, b in candidates(text):
        if (k, a, b) in true:
            yield text, k, a, b, 1
        elif over.free(a, b) and (refuted(k, text[a:b]) or not spoken_for(text, k, a, b)):
            yield text, k, a, b, 0
    for pick, (k, a, b) in enumerate(rules):
        loose = loosened(k, text[a:b], pick + a)
        part = text[max(0, a - 40) : a] + loose + text[b : b + 40]
        at = min(a, 40)
        for kind, x, y in candidates(part):
            if x <= at and y >= at + len(loose) - 1 and kind == k:
                yield part, kind, x, y, 1


def examples(text: str, most: int | None = PER_DOCUMENT) -> list[tuple[list[float], int]]:
    """Features and labels of one text's candidates, all or, to look at, about `most` evenly from them."""
    found = list(labelled(text))
    return [(features(*x), y) for *x, y in (found[:: 1 + len(found) // most] if most else found)]


class Intervals:
    """Spans' intervals as disjoint ones, in order."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> None:
        """Of an interval that is free."""
        k = bisect_left(self.starts, b)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


@dataclass
class Detector:
    forest: boosting.Forest | None
    thresholds: dict[str, float]

    def added(self, text: str, rules: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans beyond the rules' own, likeliest first, without overlap."""
        if self.forest is None:
            return []
        taken = Intervals(rules)
        spans = [s for s in candidates(text) if taken.free(s[1], s[2])]
        if not spans:
            return []
        p = np.concatenate([self.forest.probability(np.array([features(text, *s) for s in spans[k : k + BATCH]], np.float64)) for k in range(0, len(spans), BATCH)])
        out = []
        for score, (kind, a, b) in sorted(zip(p.tolist(), spans, strict=True), key=lambda x: (-x[0], x[1])):
            if score >= self.thresholds[kind] and taken.free(a, b):
                taken.add(a, b)
                out.append((kind, a, b))
        return out

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """The rules' spans and all spans, each by start, then kind."""
        rules = rule_spans(text)
        order = lambda s: (s[1], KINDS.index(s[0]), s[2])
        return sorted(rules, key=order), sorted([*rules, *self.added(text, rules)], key=order)


def learned_from(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every labelled candidate of every document, equal ones together: rows (x binary: features as doubles, y int, held boolean, n long).

    Documents with one text in three, by its hash, are held out of the trees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[bytes, int, bool]] = Counter()

        def flush() -> pa.RecordBatch:
            x, y, held = zip(*seen, strict=True)
            return pa.record_batch({"x": pa.array(x, pa.binary()), "y": pa.array(y, pa.int32()), "held": pa.array(held, pa.bool_()), "n": pa.array(seen.values(), pa.int64())})

        for held, texts in chunks(batches, "held", "text"):
            for out, text in zip(held, texts, strict=True):
                for *span, y in labelled(text):
                    seen[array("d", features(*span)).tobytes(), y, out] += 1
                    if len(seen) >= BATCH:
                        yield flush()
                        seen.clear()
        if seen:
            yield flush()

    held = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(3)) == 1
    rows = docs.select(held.alias("held"), F.col(text_col).alias("text")).mapInArrow(run, "x binary, y int, held boolean, n long")
    return table(rows.groupBy("x", "y", "held").agg(F.sum("n").alias("n")))


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(batch.num_rows, -1)


def _edges(rows: DataFrame) -> list[np.ndarray]:
    """Each feature's bins by all examples: features are counts within spans of bounded length, so that their values are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, n = _values(batch), batch.column("n").to_numpy()
                for j in range(x.shape[1]):
                    value, own = np.unique(x[:, j], return_inverse=True)
                    yield pa.record_batch({"j": pa.array(np.full(len(value), j, np.int32)), "value": pa.array(value), "n": pa.array(np.bincount(own, n).astype(np.int64))})

    counts = rows.mapInArrow(run, "j int, value double, n long").groupBy("j", "value").agg(F.sum("n").alias("n")).toPandas().sort_values(["j", "value"])
    return [boosting.quantiles(own["value"].to_numpy(), own["n"].to_numpy()) for _, own in counts.groupby("j")]


def train(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> Detector:
    """Learn from all labelled candidates of all documents; the driver gets counts of values, histograms and counts of scores.

    Texts that one in three has set the calibration and the thresholds. Without examples of both kinds only the rules act.
    """
    rows = learned_from(docs, text_col)
    own = rows.where("not held")
    edges = _edges(own)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = boosting.binned(_values(batch), edges)
                yield pa.record_batch({"code": pa.array([c.tobytes() for c in code], pa.binary()), "y": batch.column("y"), "n": batch.column("n")})

    forest = boosting.fit_table(own.mapInArrow(coded, "code binary, y int, n long"), edges) if edges else boosting.Forest(0.0)
    if not forest.trees:
        return Detector(None, {})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _values(batch)
                step = np.floor(np.clip(forest.score(x), -HIGHEST, HIGHEST) * STEPS).astype(np.int32)
                yield pa.record_batch({"kind": pa.array(x[:, : len(KINDS)].argmax(1).astype(np.int32)), "step": pa.array(step), "y": batch.column("y"), "n": batch.column("n")})

    held = rows.where("held").mapInArrow(scored, "kind int, step int, y int, n long").groupBy("kind", "step", "y").agg(F.sum("n").alias("n"))
    kind, step, y, n = held.orderBy("kind", "step", "y").toPandas().to_numpy(np.float64).T
    forest = boosting.platt(forest, step / STEPS, y, n)
    p = forest.calibrated(step / STEPS)  # of the least score of a step
    return Detector(forest, {name: max(LEAST, boosting.threshold(p[at], y[at], precision, n[at])) if (at := kind == k).any() else 1.01 for k, name in enumerate(KINDS)})


def _sha(spans: list[tuple[str, int, int]]) -> tuple[str, str]:
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return line, hashlib.sha256(line.encode()).hexdigest()


def find(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), the counts those of the rules' spans.

    Positions are code points of the whole text, ends exclusive; null texts count as empty and have no spans. Each row
    has its own result, identifiers may be null or repeated; an empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(detector)  # a fixed number of small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for keys, texts in chunks(batches, "id", "text"):
            found = [own.spans(text) for text in texts]
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in rules) for rules, _ in found], pa.int64()) for k in KINDS}
            yield pa.record_batch({"id": pa.array(keys, pa.int64()), **counts, "base_sha256": pa.array([_sha(r)[1] for r, _ in found]), "spans": pa.array([_sha(s)[0] for _, s in found])})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by its (first) kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_table(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced; null texts stay null, all other columns stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = held.value
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            clean = []
            for (texts,) in chunks(iter([batch]), text_col, size=SMALL_CHARS):
                clean += [redact(t, own.spans(t)[1]) for t in texts]
            mask = batch.column(k).is_valid().to_pylist()
            yield batch.set_column(k, batch.schema.field(k), pa.array([x if ok else None for x, ok in zip(clean, mask, strict=True)], batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, train(docs))
