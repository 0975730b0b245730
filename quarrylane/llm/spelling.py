"""Operator 11, spelling variants: words one edit apart, found by a frontier of states over a distributed trie.

A trie's edges are rows (node, char, child, mask, ends, alone) in a table by depth; a node's number is a hash of its path.
States (word, position, node, edits) meet the edges of their level by a join, level by level: a state without an edit
goes on along its word, or takes another letter (replaced) or one more (inserted), a state with one only matches. States
that end with one edit where a word ends have found a neighbour. A mask of a child's next letters lets pass only states
that can go on.

An edit lies in a word's first half or in its second. Words are therefore walked in two tries, of the words and of the
words reversed, and each starts from the node of its own first half, where few other words are left. Deletions are the
insertions of the other word, and of two words that replace a letter the one with the smaller letter finds the other.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.common import chunks, shared_dir, table

#: What a word is made of, its fewest code points and fewest occurrences, and how much more often its form occurs.
LETTERS, LEAST, OFTEN, TIMES = "A-Za-zÀ-ÿ", 7, 2, 10
#: Levels that are walked one by one. Below them, which only very long words reach, states with an edit take the rest at once.
DEEP = 40
#: Words that a task counts before it passes them on.
COUNTED = 200_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
EDGE = "node long, char int, child long, depth int, next long, ends int"
STATE = "word string, n long, back boolean, position int, node long, edits int, depth int"


def step(node: np.ndarray, char: np.ndarray) -> np.ndarray:
    """The child's number from the node's and the letter's."""
    h = (node ^ (char.astype(np.uint64) + np.uint64(1)) * _ODD[0]) * _ODD[1]
    h = (h ^ (h >> np.uint64(31))) * _ODD[2]
    return h ^ (h >> np.uint64(29))


class Paths:
    """The paths of words in a trie, level by level: letters(t) and nodes(t) of the first count(t) words, longest first."""

    def __init__(self, words: list[str], back: bool):
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        first = (np.cumsum(size) - size)[self.order]
        self.at, self.sign = (first + self.size - 1, -1) if back else (first, 1)
        self.half = self.size - self.size // 2 if back else self.size // 2
        self.root = np.uint64(1 + back)

    def count(self, t: int) -> int:
        return int(np.searchsorted(-self.size, -t, "left"))

    def letters(self, t: int) -> np.ndarray:
        """Letter t (from 0) of the words that have one."""
        return self.codes[self.at[: self.count(t)] + self.sign * t]

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(t, nodes at depth t, nodes at depth t + 1) of the words with a letter t."""
        node = np.full(len(self.size), self.root)
        for t in range(int(self.size.max(initial=0))):
            many = self.count(t)
            child = step(node[:many], self.letters(t))
            yield t, node[:many], child
            node = child


def bit(char: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (char.astype(np.uint64) & np.uint64(63))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each word's paths, from one letter before its middle on."""
    for batch in batches:
        for back in (False, True):
            paths = Paths(batch.column("word").to_pylist(), back)
            for t, node, child in paths.walk():
                at = np.flatnonzero(paths.half[: len(node)] - 1 <= t)
                if len(at):
                    after = np.zeros(len(node), np.uint64)
                    following = paths.letters(t + 1)
                    after[: len(following)] = bit(following)
                    yield pa.record_batch({
                        "node": pa.array(node[at].view(np.int64)), "char": pa.array(paths.letters(t)[at].astype(np.int32)), "child": pa.array(child[at].view(np.int64)),
                        "depth": pa.array(np.full(len(at), min(t, DEEP), np.int32)), "next": pa.array(after[at].view(np.int64)),
                        "ends": pa.array((paths.size[at] == t + 1).astype(np.int32)),
                    })


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word's states at its middle, in both tries, words written in the trie's direction; depth -1 are the words' ends."""
    for batch in batches:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        for back in (False, True):
            paths = Paths(words, back)
            middle, end = np.full(len(words), paths.root), np.full(len(words), paths.root)
            for t, _, child in paths.walk():
                now = np.flatnonzero(paths.half[: len(child)] == t + 1)
                middle[now] = child[now]
                now = np.flatnonzero(paths.size[: len(child)] == t + 1)
                end[now] = child[now]
            own = [words[i][::-1] if back else words[i] for i in paths.order.tolist()]
            for node, position, depth in ((middle, paths.half, np.minimum(paths.half, DEEP)), (end, paths.size, np.full(len(own), -1))):
                yield pa.record_batch({
                    "word": pa.array(own, pa.string()), "n": pa.array(n[paths.order]), "back": pa.array(np.full(len(own), back)), "position": pa.array(position.astype(np.int32)),
                    "node": pa.array(node.view(np.int64)), "edits": pa.array(np.zeros(len(own), np.int32)), "depth": pa.array(depth.astype(np.int32)),
                })


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States without an edit at all their word's places from theirs on; others pass."""
    for batch in batches:
        for r in batch.to_pylist():
            own, node = np.frombuffer(r["word"].encode("utf-32-le"), np.uint32), np.array([r["node"]], np.int64).view(np.uint64)
            places, nodes = [r["position"]], [r["node"]]
            if not r["edits"]:
                for t in range(r["position"], len(own)):
                    node = step(node, own[t : t + 1])
                    places.append(t + 1)
                    nodes.append(int(node.view(np.int64)[0]))
            for k in range(0, len(places), 1000):
                some = places[k : k + 1000]
                yield pa.record_batch({"word": pa.array([r["word"]] * len(some)), "n": pa.array([r["n"]] * len(some), pa.int64()), "back": pa.array([r["back"]] * len(some)), "position": pa.array(some, pa.int32()), "node": pa.array(nodes[k : k + 1000], pa.int64()), "edits": pa.array([r["edits"]] * len(some), pa.int32())})


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States with an edit, moved to the end of their word: whether a word ends there is asked later."""
    for batch in batches:
        for r in batch.to_pylist():
            own, node = np.frombuffer(r["word"].encode("utf-32-le"), np.uint32), np.array([r["node"]], np.int64).view(np.uint64)
            for t in range(r["position"], len(own)):
                node = step(node, own[t : t + 1])
            yield pa.record_batch({"word": pa.array([r["word"]]), "n": pa.array([r["n"]], pa.int64()), "back": pa.array([r["back"]]), "node": pa.array(node.view(np.int64))})


def _advanced(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States moved along the edges of their nodes; `found` where a word ends one edit away."""
    size, at = F.length("word"), F.col("position")
    own, following = F.ascii(F.substring("word", at + 1, F.lit(1))), F.ascii(F.substring("word", at + 2, F.lit(1)))

    def may(position: Column, char: Column) -> Column:
        """Whether a state at this position can go on from the child."""
        has = F.shiftrightunsigned("mask", 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(char, F.lit(64)))) != 0
        return F.when(position >= size, F.col("ends") == 1).otherwise(has)

    clean, here = F.col("edits") == 0, (at < size) & (F.col("char") == own)
    move = lambda position, edits: F.struct(position.alias("position"), F.lit(edits).alias("edits"))
    along = F.when(clean & here & ~F.col("alone"), move(at + 1, 0)).when(~clean & here & may(at + 1, following), move(at + 1, 1))
    replaced = F.when(clean & (at < size) & (F.col("char") > own) & may(at + 1, following), move(at + 1, 1))
    inserted = F.when(clean & ~here & may(at, own), move(at, 1))
    moved = states.join(edges, "node").select("word", "n", "back", F.col("child").alias("node"), "ends", F.explode(F.array_compact(F.array(F.coalesce(along, replaced), inserted))).alias("to"))
    found = (F.col("to.edits") == 1) & (F.col("to.position") >= size) & (F.col("ends") == 1)
    return moved.select("word", "n", "back", "to.position", "node", "to.edits", found.alias("found"))


def neighbours(words: DataFrame) -> DataFrame:
    """Rows (word, n, other, other_n) for words (word string, n long; words are distinct) that are one edit apart, both ways.

    Null words have none. A level is one join by node, which Spark splits where a node has very many words; a node has at
    most as many edges as there are letters. As many rounds as the longest word has letters, at most DEEP.
    """
    spark = words.sparkSession
    words = words.where("word is not null")
    path = shared_dir(spark)
    by_child = words.select("word").mapInArrow(_edges, EDGE).groupBy("child").agg(
        F.min("node").alias("node"), F.min("char").alias("char"), F.min("depth").alias("depth"), F.bit_or("next").alias("mask"), F.max("ends").alias("ends"), (F.count("*") == 1).alias("alone")
    )
    by_child.write.partitionBy("depth").parquet(f"{path}/edges")
    edges = spark.read.schema("child long, node long, char int, mask long, ends int, alone boolean, depth int").parquet(f"{path}/edges")
    words.mapInArrow(_starts, STATE).write.partitionBy("depth").parquet(f"{path}/starts")
    starts = spark.read.schema(STATE).parquet(f"{path}/starts")
    ends = starts.where("depth = -1").select("node", F.col("word").alias("other"), F.col("n").alias("other_n"))
    deepest = words.agg(F.max(F.length("word"))).first()[0] or 0
    carried, found = None, []
    kept = [F.col(c) for c in ("word", "n", "back", "position", "node", "edits")]
    for depth in range(min(deepest + 1, DEEP)):
        states = starts.where(F.col("depth") == depth).select(*kept)
        states = states if carried is None else states.unionByName(carried)
        out = f"{path}/level={depth}"
        _advanced(states, edges.where(F.col("depth") == depth).drop("depth")).write.partitionBy("found").parquet(out)
        level = spark.read.schema("word string, n long, back boolean, position int, node long, edits int, found boolean").parquet(out)
        carried = level.where("not found").select(*kept)
        found.append(level.where("found").select("word", "n", "back", "node"))
    if deepest >= DEEP:  # long words: all their places at once, and the rest after an edit
        below = "word string, n long, back boolean, position int, node long, edits int"
        states = starts.where(F.col("depth") == DEEP).select(*kept)
        states = states if carried is None else states.unionByName(carried)
        moved = _advanced(states.where("edits = 0").mapInArrow(_below, below), edges.where(F.col("depth") == DEEP).drop("depth")).where("edits = 1").select(*kept)
        found.append(table(moved.unionByName(states.where("edits = 1")).mapInArrow(_rest, "word string, n long, back boolean, node long")))
    none = spark.createDataFrame([], "word string, n long, back boolean, node long")
    met = reduce(DataFrame.unionByName, found, none).join(ends, "node")
    one = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    pairs = table(met.select(one("word").alias("word"), "n", one("other").alias("other"), "other_n").where(F.levenshtein("word", "other", 1) == 1))
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))).repartition("word").dropDuplicates(["word", "other"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, often: int = OFTEN, misspell: int | None = None) -> DataFrame:
    """Rows (word, n): runs of letters of at least `least` code points, A-Z lower-cased, that occur at least `often` times.

    With `misspell`, a run loses a letter where misspell divides h, the crc32 of `<id>:<run>`: code point h mod its length. A
    null identifier counts as empty there. Null texts have no words. Counts of a task are added up before they are shuffled.
    """
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.record_batch({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return out

        for ids, texts in chunks(batches, "id", "text"):
            for i, text in zip(ids, texts, strict=True):
                own = Counter(pattern.findall(text.encode().lower().decode()))
                if misspell:
                    head = zlib.crc32(b":" if i is None else f"{i}:".encode())
                    for word in [w for w in own if not zlib.crc32(w.encode(), head) % misspell]:
                        n, at = own.pop(word), zlib.crc32(word.encode(), head) % len(word)
                        if len(word) > least:
                            total[word[:at] + word[at + 1 :]] += n
                total.update(own)
            if len(total) > COUNTED:
                yield counted()
        yield counted()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def spelling_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """A row (word, n, n_near, form, form_n, root) for each of words (word, n): its variants and what it is a variant of.

    n_near are the words one edit apart; form the most frequent of them (of ties the smallest by code points) where it
    occurs at least `times` as often, else null; root is where the forms end, the word itself where it has none. Null words
    are left out, repeated ones have to be added up before; an empty table gives no rows.
    """
    if times < 2:
        raise ValueError("a form has to be more frequent than its word")
    words = table(words.where("word is not null").select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best")
    near = neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.m") >= times * F.col("n")
    out = table(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")))
    to = out.where("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1.0, math.log(most, times) + 1)))):  # each form occurs `times` as often, so that few follow each other
        to = table(to)
        then = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        to = to.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return out.join(to, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, some of them misspelt by rule, with their forms and roots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_groups(word_counts(docs, misspell=31)).select("word", "form", "root", "n", "n_near", "form_n")
