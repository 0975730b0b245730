"""Search within texts without comparing everything with everything: catalogues of words, citations, indexed substrings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.session import CARRIED, carried, spread, table

#: Bytes of entries in one automaton; a larger catalogue is several passes over the texts.
AUTOMATON_BYTES = 16 << 20
#: Fingerprints of texts: hashes of GRAM bytes, the smallest of each WINDOW in a row. Citations of LONG bytes have one in common
#: with every text that contains them.
GRAM, WINDOW = 12, 13
LONG = GRAM + WINDOW - 1


def _lower(text: str) -> str:
    """A-Z in lower case: no character changes its place."""
    return text.encode().lower().decode()


class Automaton:
    """Aho-Corasick over entries; an entry may be looked for as a word, whatever its case (A-Z)."""

    def __init__(self, entries: list[str], words: bool):
        import ahocorasick

        self.words, self.machine = words, ahocorasick.Automaton()
        of: dict[str, list[int]] = {}
        for i, entry in enumerate(entries):
            if entry:
                of.setdefault(_lower(entry) if words else entry, []).append(i)
        for key, own in of.items():
            self.machine.add_word(key, (len(key), own))
        self.machine.make_automaton()
        self.some = bool(of)

    def found(self, text: str) -> list[int]:
        """The numbers of the entries that the text has, in order."""
        if not self.some:
            return []
        out: set[int] = set()
        text = _lower(text) if self.words else text
        word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        for end, (size, own) in self.machine.iter(text):
            if own[0] not in out and (not self.words or (word(end - size) != word(end - size + 1) and word(end) != word(end + 1))):
                out.update(own)
        return sorted(out)


@lru_cache(4)
def _automaton(number: int, application: str, entries: tuple[str, ...], words: bool) -> Automaton:
    return Automaton(list(entries), words)


def _matches(rows: DataFrame, entries: DataFrame, words: bool) -> DataFrame:
    """Rows (key, places array<long>) of rows (key, text): the entries (place long, entry string) that a text has, in passes."""
    size = entries.agg(F.coalesce(F.sum(F.octet_length("entry") + 16), F.lit(0))).first()[0]
    passes = max(1, math.ceil(size / AUTOMATON_BYTES))
    kind = rows.schema["key"].dataType.simpleString()

    def one(own: DataFrame) -> DataFrame:
        got = own.orderBy("place").collect()  # AUTOMATON_BYTES, about
        held = rows.sparkSession.sparkContext.broadcast((tuple(r.entry for r in got), np.array([r.place for r in got], np.int64)))
        number = id(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, places = held.value
            machine = _automaton(number, str(TaskContext.get() and TaskContext.get().getLocalProperty("spark.app.id")), names, words)
            for batch in batches:
                for k in range(0, batch.num_rows, 500):
                    part = batch.slice(k, 500)
                    found = [None if t is None else places[machine.found(t)].tolist() for t in part.column("text").to_pylist()]
                    yield pa.record_batch({"key": part.column("key"), "places": pa.array(found, pa.list_(pa.int64()))})

        return rows.mapInArrow(run, f"key {kind}, places array<long>")

    if passes == 1:
        return one(entries)
    found = reduce(DataFrame.unionByName, [one(entries.where(F.pmod(F.xxhash64("entry"), F.lit(passes)) == i)) for i in range(passes)])
    return found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))


def catalogue_matches(docs: DataFrame, catalogue: DataFrame, text_col: str = "text", entry_col: str = "entry", place_col: str = "place", into: str = "found") -> DataFrame:
    """docs with `found`: the catalogue's entries (place long, entry string) that a text names as words, in order of their places.

    Whatever their case (A-Z); a word's border is where a letter, digit or _ meets something else. The catalogue may have any
    size: it goes out as automatons of at most about AUTOMATON_BYTES, each a pass over the texts, and the plan doesn't grow
    with it. Null texts have null; null and empty entries aren't found.
    """
    entries = table(catalogue.where(F.col(entry_col) != "").select(F.col(place_col).cast("long").alias("place"), F.col(entry_col).alias("entry")))
    keyed = table(spread(docs).withColumn("search_key", F.monotonically_increasing_id()))
    found = _matches(keyed.select(F.col("search_key").alias("key"), F.col(text_col).alias("text")), entries, True)
    named = found.select("key", F.posexplode("places").alias("at", "place")).join(carried(entries), "place").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"]).alias(into))
    empty = F.when(F.col(text_col).isNotNull(), F.array().cast("array<string>"))
    return keyed.join(named, keyed["search_key"] == named["key"], "left").withColumn(into, F.coalesce(into, empty)).drop("search_key", "key")


def fingerprints(data: bytes) -> np.ndarray:
    """The winnowed hashes of a text: each stretch of LONG bytes has one of them."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(b) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + b[k : k + n] + np.uint64(1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least = h[: n - WINDOW + 1].copy()
    for k in range(1, WINDOW):
        np.minimum(least, h[k : n - WINDOW + 1 + k], out=least)
    return np.unique(least[np.append(True, least[1:] != least[:-1])]).view(np.int64)


def _printed(rows: DataFrame, only, least: bool) -> DataFrame:
    """Rows (key, print) of rows (key, text): all fingerprints, the least alone, or those in `only` (sorted, broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                own = [fingerprints((t or "").encode()) for t in part.column("text").to_pylist()]
                if least:  # numpy sorts signed numbers: any one fixed choice serves
                    own = [x[:1] for x in own]
                elif only is not None and len(only.value):
                    own = [x[np.isin(x, only.value)] for x in own]
                at = np.repeat(np.arange(len(own)), [len(x) for x in own])
                yield pa.record_batch({"key": part.column("key").take(pa.array(at)), "print": pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))})

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, print long")


def contained(docs: DataFrame, quotes: DataFrame, id_col: str = "doc_id", text_col: str = "text", quote_id: str = "quote_id", quote_col: str = "quote") -> DataFrame:
    """Pairs (doc id, quote id) where the text contains the quote, verbatim. Both sides may have any size.

    Quotes of LONG bytes meet texts by a fingerprint, in an equi join, and are then looked for; shorter ones are an
    automaton's entries. The empty quote is in every text; null texts and quotes are in none.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    asked = table(quotes.where(F.col(quote_col).isNotNull()).select(F.col(quote_id).alias("quote_id"), F.col(quote_col).alias("quote"), F.xxhash64(quote_col).alias("place")))
    size, pair = F.octet_length("quote"), [F.col("key").alias(id_col), F.col("quote_id").alias(quote_id)]
    long_, short = asked.where(size >= LONG), asked.where((size > 0) & (size < LONG))
    prints = table(_printed(long_.select(F.struct("quote_id", "place").alias("key"), F.col("quote").alias("text")), None, True).select("key.quote_id", "key.place", "print"))
    few = prints.select("print").distinct().limit(CARRIED + 1).collect()  # longs, at most CARRIED of them: tasks pass on no others
    only = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["print"] for r in few], np.int64))) if len(few) <= CARRIED else None
    met = _printed(spread(rows), only, False).join(carried(prints), "print").select("key", "quote_id", "place").distinct()
    near = table(met)
    found = rows.join(carried(near), "key").join(carried(long_), ["quote_id", "place"]).where(F.contains("text", "quote")).select(*pair)
    if not short.isEmpty():
        entries = table(short.select("place", F.col("quote").alias("entry")).distinct())
        hits = _matches(spread(rows), entries, False).select("key", F.explode("places").alias("place"))
        found = found.unionByName(hits.join(carried(short.select("place", "quote_id")), "place").select(*pair))
    empty = asked.where(size == 0).select("quote_id").distinct()
    if not empty.isEmpty():  # the answer itself: each of those quotes with each text
        found = found.unionByName(rows.select("key").crossJoin(empty).select(*pair))
    return found.distinct()
