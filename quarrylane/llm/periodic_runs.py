"""Operator 13, periodic runs of words, by enhanced suffix arrays.

A square is a stretch of 2q words whose halves are equal; it branches if the word after it breaks the period. Every run's
last square branches. For each LCP interval the suffixes of the smaller child are asked whether the suffix `depth` words
on, or back, lies in the other child (by its rank alone, no tree is built): that is a branching square. Squares are then
rotated to the left as far as the period holds, which gives the run, and those whose period is a multiple of the run's
smallest are dropped.

One suffix array serves a batch of documents: words of different documents never are equal in it. Before it is built,
documents without any repeated stretch of as many words as a run has to share with itself are set aside, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.common import chunks

#: A run has at least LEAST words and EXPONENT periods.
LEAST, EXPONENT = 24, 3
#: Suffixes that are asked at once, which bounds memory whatever the length of a text.
ASKED = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def shared_words(least: int, exponent: int) -> int:
    """The words that a run and itself, one period on, have in common at least: length - q, of length >= max(least, exponent q)."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def repeating(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which documents (words starts[d] to starts[d + 1] of ids) may have some stretch of `width` words twice; others have none."""
    n, out = len(ids), np.zeros(len(starts) - 1, bool)
    if n < width:
        return out
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    have, whole = 1, h
    result, covered = None, 0
    while True:  # hashes of stretches of 1, 2, 4, ... words, put together to `width` by its binary digits
        if width & have:
            result = whole.copy() if result is None else result[: n - covered - have + 1] * _MIX + whole[covered : n - have + 1]
            covered += have
        if covered == width:
            break
        whole = (whole[:-have] * (_MIX + np.uint64(2 * have))) + whole[have:]
        whole ^= whole >> np.uint64(31)
        have *= 2
    size = np.diff(starts)
    inside = np.maximum(size - width + 1, 0)
    doc = np.repeat(np.arange(len(size)), inside)
    at = np.repeat(starts[:-1] - (np.cumsum(inside) - inside), inside) + np.arange(int(inside.sum()))
    key = (result[at] ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * _MIX
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    out[doc[order[same]]] = True  # documents that clash by chance are looked at in vain
    return out


def suffix_array(ids: np.ndarray, starts: np.ndarray, apart: bool = True, depth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes' order, their ranks and the LCP array (first and last entry 0) of documents, by prefix doubling.

    Suffixes end with their document. Kept apart, documents have no words in common. With `depth`, suffixes that share so
    many words needn't be told from each other; their LCP is at least that.
    """
    n = len(ids)
    size = np.diff(starts)
    doc, end = np.repeat(np.arange(len(size)), size), np.repeat(starts[1:], size)
    rank = np.unique(doc * (int(ids.max()) + 1) + ids if apart else ids, return_inverse=True)[1]
    levels, at, k = [], np.arange(n), 1
    while int(rank.max()) < n - 1 and (depth is None or k < depth):
        levels.append(rank.astype(np.int32))
        after = np.where(at + k < end, rank[np.minimum(at + k, n - 1)] + 1, 0)
        rank = np.unique(rank.astype(np.int64) * (n + 1) + after, return_inverse=True)[1]
        k *= 2
    if depth is not None:
        levels.append(rank.astype(np.int32))
    order = np.argsort(rank, kind="stable")
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n + 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):  # equal ranks are equal stretches of 2^level words, if both are so long
        r, width = levels.pop(), 1 << level
        fits = (a + width <= end[order[:-1]]) & (b + width <= end[order[1:]])
        step = np.where(fits & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)]), width, 0)
        a += step
        b += step
        lcp[1:n] += step
    return order, rank, lcp


def _bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each LCP entry the last one before it that isn't greater, and the first one after it that is smaller."""
    values = lcp.tolist()
    before, after, open_ = [0] * len(values), [0] * len(values), [0]
    for k in range(1, len(values)):
        x = values[k]
        while values[open_[-1]] > x:
            after[open_.pop()] = k
        before[k] = open_[-1]
        open_.append(k)
    return np.array(before), np.array(after)


def branching_squares(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and half-lengths of all branching squares of words within documents."""
    n = len(ids)
    order, rank, lcp = suffix_array(ids, starts)
    before, after = _bounds(lcp)
    split = np.flatnonzero(lcp > 0)
    lo, hi = before[split], after[split]  # children are [lo, split) and [split, hi)
    left = split - lo <= hi - split
    first, size = np.where(left, lo, split), np.where(left, split - lo, hi - split)
    other_lo, other_hi = np.where(left, split, lo), np.where(left, hi, split)
    places, halves = [], []
    cut = np.append(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), ASKED), "right"), len(size))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = slice(a, b)
        many = size[own]
        at = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        i, depth = order[at], np.repeat(lcp[split[own]], many)
        low, high = np.repeat(other_lo[own], many), np.repeat(other_hi[own], many)
        for sign in (1, -1):
            j = i + sign * depth
            ok = np.flatnonzero((j >= 0) & (j < n))
            r = rank[j[ok]]
            ok = ok[(low[ok] <= r) & (r < high[ok])]
            places.append(np.minimum(i[ok], j[ok]))
            halves.append(depth[ok])
    return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *halves])


def _rotated(ids: np.ndarray, at: int, half: int, lo: int) -> int:
    """How far the square at `at` can be rotated to the left, at most to lo."""
    n, step = 0, 64
    while (m := min(step, at - n - lo)) > 0:
        to = at - n
        odd = np.flatnonzero(ids[to - m : to] != ids[to + half - m : to + half])
        if len(odd):
            return n + m - 1 - int(odd[-1])
        n, step = n + m, step * 2
    return n


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> dict[int, list[Run]]:
    """For each document that has any, its runs (start, length, period) by start, then period."""
    found: dict[int, list[Run]] = {}
    some = np.flatnonzero(repeating(ids, starts, shared_words(least, exponent)))
    if not len(some):
        return found
    size = np.diff(starts)[some]
    begin = np.append(0, np.cumsum(size))
    words = ids[np.repeat(starts[:-1][some] - begin[:-1], size) + np.arange(int(size.sum()))]
    at, half = branching_squares(words, begin)
    doc = np.searchsorted(begin, at, "right") - 1
    lo, end = begin[doc], at + 2 * half
    need = np.maximum(least, exponent * half)
    fits = np.flatnonzero(end - need >= lo)
    fits = fits[words[(end - need)[fits]] == words[(end - need + half)[fits]]]
    fits = fits[np.lexsort((end[fits], half[fits]))]
    ends: dict[int, list[tuple[int, int]]] = {}
    for x in fits.tolist():
        e, q, low, a = int(end[x]), int(half[x]), int(lo[x]), int(at[x])
        known = ends.setdefault(e, [])
        if any(s <= a and q % p == 0 for s, p in known):
            continue  # within a run with this end, whose period it has several times, or that run again
        start = a - _rotated(words, a, q, low)
        if e - start >= need[x]:
            known.append((start, q))
            found.setdefault(int(some[doc[x]]), []).append((start - low, e - start, q))
    return {d: sorted(rs, key=lambda r: (r[0], r[2])) for d, rs in found.items()}


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words no run has after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exponent; of ties the first by start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """A row (id, n_words long, runs, collapsed string) for each document: its periodic runs, and its text without the repeats.

    Words are cut at ASCII white space. A run is a stretch of words of smallest period q, of at least max(least, exponent q)
    words, that can't be longer. runs is an array of (start, length, period), all long, by start, then period; collapsed has
    the words that no run has after its first period, joined by one space. Null and empty texts have no words; identifiers
    may be null or repeated, each row is answered; texts are read whole, each within one task; of other columns none
    matters; an empty table gives no rows.
    """
    if least < 2 or exponent < 2:
        raise ValueError("a run has at least two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, "id", "text"):
            cut = [t.encode().split() for t in texts]
            counts = np.fromiter(map(len, cut), np.int64, len(cut))
            starts = np.append(0, np.cumsum(counts))
            codes = pa.array([w for words in cut for w in words], pa.binary()).dictionary_encode().indices
            found = runs_of(codes.to_numpy(zero_copy_only=False).astype(np.int64), starts, least, exponent)
            for d, runs in found.items():
                cut[d] = [cut[d][i] for i in np.flatnonzero(kept_words(len(cut[d]), runs)).tolist()]
            yield pa.record_batch({
                "id": pa.array(rows, pa.int64()), "n_words": pa.array(counts),
                "runs": pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(d, ())] for d in range(len(cut))], RUNS),
                "collapsed": pa.array([b" ".join(words) for words in cut], pa.binary()).cast(pa.string()),
            })

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))


def with_periods(text: Column, key: Column) -> Column:
    """The text, for one key in ten with its words from some place on replaced by repetitions of the first few of them.

    The contract's rule: h = crc32(key), g = h div 10; if h mod 10 is 0, words from g mod n on repeat with a period of 1 +
    (n - a) div (3 + g mod 8). A null key leaves the text alone.
    """
    h = F.crc32(F.encode(key.cast("string"), "UTF-8"))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, F.nullif(n, F.lit(0))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its runs of words, the strongest of them, and digests of the runs and of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_runs(docs.select("doc_id", with_periods(F.col("text"), F.col("doc_id")).alias("text")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
