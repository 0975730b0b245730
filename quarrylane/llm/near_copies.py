"""Near copies by word shingles, for the pipeline: operator 9 and MinHash bands propose, exact shingle similarity decides.

Texts whose shingles have a similarity (intersection by union) of 0.8 or more are near copies. Texts with the same
shingles are one first. Then operator 9's search links SimHash fingerprints of the others' shingles at four bits or
fewer, and what it connects meets. Fingerprints of 64 bits can't seek as far as 0.8: there they differ in about ten bits
and often in seventeen, for which segments that differ in one bit at most would be seven bits long and held by most of a
corpus. So texts meet also under 20 bands of 5 minima (a pair of similarity J under at least one with probability
1 - (1 - J^5)^20, 0.9996 at 0.8). All that meet are compared exactly. Texts that no other meets are cleared by a bounded
filter and stay where they are.

What bands connect meets as a whole, each text travelling once, unless it is too much for a task. Then pivots come
first: the texts that lead its bands go to all its parts and are compared with every text, which travels once again.
What they link needs no comparison among itself any more, so that afterwards a band's largest class meets only what
isn't in it. Copies of one text, however many, are settled by the pivots; only texts that bands bring together and that
aren't similar go on to meet one another in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm import simhash
from quarrylane.llm.common import SMALL_CHARS, chunks, components, forget, table
from quarrylane.llm.exact_dedup import filter_words, id_filter, may_hold
from quarrylane.llm.language_model import _POWER, _mixed, sequences
from quarrylane.session import carried

#: The words of a shingle, the least similarity of near copies, bands and the minima of one.
WIDTH, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 5
#: Texts, and their shingles, that meet in one task (one larger text may come with them). Where bands connect more, pivots come
#: first and blocks of this size meet afterwards; the groups found are the same.
BLOCK, WEIGHT = 2048, 1 << 20
#: A text is a pivot if it leads this part of its texts' bands, by their texts: so there are at most as many.
PIVOTS = 32
#: The most meetings (two numbers each) that go to the texts by broadcast; more are joined by a shuffle.
CARRIED = 1 << 20

_ODD, _ADD = np.random.default_rng(20241107).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, one text after the other, and where each text's begin.

    Words are operator 9's: cut at ASCII white space, A-Z lower-cased. With fewer than `width` words the whole sequence
    is the one shingle, with none there is no shingle. The places have one more at the end.
    """
    seq, counts = sequences(texts)
    begin, words = np.cumsum(counts + 1) - counts, counts - 1
    owner, found = [], []
    for n in range(1, width + 1):
        own = np.flatnonzero(words == n if n < width else words >= n)
        many = np.ones(len(own), np.int64) if n < width else words[own] - width + 1
        at = np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * _POWER + seq[at + k]
        owner.append(np.repeat(own, many))
        found.append(_mixed(h))
    who, h = np.concatenate(owner), np.concatenate(found)
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (who[1:] != who[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], np.searchsorted(who[new], np.arange(len(texts) + 1))


def bands(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text's shingles (none is empty) the keys of its bands, as rows of longs."""
    keys = []
    for b in range(BANDS):
        h = np.full(len(starts) - 1, b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = _mixed(h * _POWER + np.minimum.reduceat(values * _ODD[k] + _ADD[k], starts[:-1]))
        keys.append(h)
    return np.stack(keys, axis=1).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for rows, ids, texts in chunks(batches, "row", "id", "text", size=SMALL_CHARS):
        values, starts = shingle_sets(texts)
        some = np.flatnonzero(np.diff(starts))
        keys = bands(values, np.append(starts[some], len(values))).reshape(-1) if len(some) else np.zeros(0, np.int64)
        sizes = np.zeros(len(texts), np.int32)
        sizes[some] = BANDS
        whole = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        fps = np.array([simhash.majority(values[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], np.uint64).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(keys, pa.int64()))
        yield pa.record_batch({"row": pa.array(rows, pa.int64()), "id": pa.array(ids, pa.int64()), "whole": pa.array(whole, pa.binary()), "shingles": pa.array(np.diff(starts), pa.int64()), "fp": pa.array(fps, pa.int64()), "keys": lists})


def _alike(own: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each of several texts' shingles, none empty, whether they are similar enough to `own`."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    theirs = np.concatenate(sets)
    hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
    return both >= least * (len(own) + size - both) - 1e-9


def similar(nodes: np.ndarray, sets: list[np.ndarray], classes: np.ndarray, least: float) -> tuple[list, list]:
    """Links between texts whose shingles are similar enough, as a spanning set: each class is reached once, breadth first.

    Texts of one class are known to be connected: they aren't compared with each other, and are reached together.
    """
    left, right = [], []
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    rest = np.arange(len(nodes))
    while len(rest):
        first = classes[rest] == classes[rest[0]]
        frontier, rest = rest[first].tolist(), rest[~first]
        while frontier and len(rest):
            k = frontier.pop()
            fit = rest[np.minimum(size[rest], size[k]) >= least * np.maximum(size[rest], size[k])]
            if not len(fit):
                continue
            near = fit[_alike(sets[k], [sets[j] for j in fit], least)]
            if not len(near):
                continue
            left += [nodes[k]] * len(near)
            right += nodes[near].tolist()
            reached = np.isin(classes[rest], classes[near])
            frontier += rest[reached].tolist()
            rest = rest[~reached]
    return left, right


#: Parts that a text plays in a meeting: compared with all that meet it there by class, or with its pivots alone.
PLAIN, MEMBER, PIVOT = 0, 1, 2


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, classes, sets, pivots = None, [], [], [], []
        left, right = [], []

        def settle():
            a, b = similar(np.array(nodes), sets, np.array(classes), least)
            left.extend(a)
            right.extend(b)

        for keys, parts, own, groups, texts in chunks(batches, "key", "part", "node", "class", "text", size=SMALL_CHARS):
            values, starts = shingle_sets(texts)
            for i, (k, part, node, group) in enumerate(zip(keys, parts, own, groups, strict=True)):
                if k != key:
                    if len(nodes) > 1:
                        settle()
                    key, nodes, classes, sets, pivots = k, [], [], [], []
                mine = values[starts[i] : starts[i + 1]]
                if part == PIVOT:
                    pivots.append((node, mine.copy()))
                elif part == MEMBER:
                    met = [(n, s) for n, s in pivots if n != node and min(len(s), len(mine)) >= least * max(len(s), len(mine))]
                    for (n, _), near in zip(met, _alike(mine, [s for _, s in met], least) if met else [], strict=True):
                        if near:
                            left.append(n)
                            right.append(node)
                else:
                    nodes.append(node)
                    classes.append(group)
                    sets.append(mine.copy())
            if left:
                yield pa.record_batch({"src": pa.array(left, pa.int64()), "dst": pa.array(right, pa.int64())})
                left, right = [], []
        if len(nodes) > 1:
            settle()
        if left:
            yield pa.record_batch({"src": pa.array(left, pa.int64()), "dst": pa.array(right, pa.int64())})

    return run


def _links(texts: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """Links (src, dst) that the meetings (key, part, node, class) of texts (node, text) give; of a meeting pivots come first."""
    rows = texts.join(F.broadcast(met) if met.count() <= CARRIED else met, "node").select("key", "part", "node", "class", "text")
    return rows.repartition(F.col("key")).sortWithinPartitions("key", F.desc("part")).mapInArrow(_verify(least), "src long, dst long")


def _cut(n: str, weight: str):
    """The blocks into which texts of that number and weight are cut."""
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(weight) / WEIGHT), F.lit(1)).cast("int")


def _upto(n) -> F.Column:
    return F.sequence(F.lit(0), n - 1)


def pivot_meetings(banded: DataFrame) -> DataFrame:
    """Meetings of all texts of banded (key, n, node, component, blocks) with pivots of their component, in parts of it.

    A band is led by the text whose bands have the most texts in all: the one that copies come from, if it is there.
    """
    score = banded.groupBy("node").agg(F.sum("n").alias("score"))
    leads = banded.join(score, "node").groupBy("key").agg(F.max_by(F.struct("component", "node", "blocks", "n"), F.struct("score", "node")).alias("lead"))
    led = table(leads.groupBy("lead.component", "lead.node", "lead.blocks").agg(F.sum("lead.n").alias("led")))
    total = carried(table(led.groupBy("component").agg(F.sum("led").alias("total"))))
    pivots = led.join(total, "component").where(F.col("led") * PIVOTS >= F.col("total")).select("component", "node", F.explode(_upto(F.col("blocks"))).alias("own"), F.lit(PIVOT).alias("part"))
    members = banded.select("component", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"), F.lit(MEMBER).alias("part")).distinct()
    return pivots.unionByName(members).select(F.xxhash64("component", "own").alias("key"), "part", "node", F.col("node").alias("class"))


def block_meetings(banded: DataFrame, known: DataFrame) -> DataFrame:
    """Meetings within the bands of banded (key, node, shingles) of all texts that known (node, component) doesn't connect.

    A band whose texts are one class has none. Else its largest class, in blocks, meets the other texts, in blocks; these
    meet one another two by two; the blocks of the largest class don't.
    """
    own = table(banded.join(known, "node", "left").select("key", "node", "shingles", F.coalesce(known["component"], "node").alias("class")))
    each = own.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("shingles").alias("weight"))
    most = each.groupBy("key").agg(F.max(F.struct("n", "class", "weight")).alias("top"), F.sum("n").alias("all"), F.sum("weight").alias("whole"), F.count("*").alias("classes"))
    most = most.where("classes > 1").select("key", F.col("top.class").alias("largest"), F.col("top.n").alias("n"), F.col("top.weight").alias("weight"), (F.col("all") - F.col("top.n")).alias("n_rest"), (F.col("whole") - F.col("top.weight")).alias("weight_rest"))
    cut = table(most.select("key", "largest", _cut("n", "weight").alias("blocks"), _cut("n_rest", "weight_rest").alias("others")))
    inside = F.col("class") == F.col("largest")
    rows = own.join(cut, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.when(inside, F.col("blocks")).otherwise(F.col("others"))).cast("int"))
    first = rows.select("node", "class", F.explode(F.when(inside, F.transform(_upto(F.col("others")), lambda k: F.xxhash64("key", F.lit(0), k, "own"))).otherwise(F.transform(_upto(F.col("blocks")), lambda k: F.xxhash64("key", F.lit(0), "own", k)))).alias("key"))
    pairs = F.transform(F.filter(_upto(F.col("others")), lambda k: k != F.col("own")), lambda k: F.xxhash64("key", F.lit(1), F.least(k, F.col("own")), F.greatest(k, F.col("own"))))
    second = rows.where(~inside & (F.col("others") > 1)).select("node", "class", F.explode(pairs).alias("key"))
    # Meetings that share a hash by chance are one: more is compared, nothing is missed.
    return first.unionByName(second).select("key", F.lit(PLAIN).alias("part"), "node", "class")


def fingerprint_keys(distinct: DataFrame) -> DataFrame:
    """Keys (node, key) of texts of distinct (node, shingles, fp) that operator 9's links connect with others: one for each such group."""
    prints = table(distinct.where("shingles > 0").groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")))
    found = table(components(simhash.links(prints)))
    # components() names every node that has a link; other fingerprints matter only where several texts have them.
    named = prints.join(found, "node", "left").where("n > 1 or component is not null").select("fp", F.coalesce("component", "node").alias("component"))
    return distinct.where("shingles > 0").join(carried(table(named)), "fp").select("node", F.xxhash64(F.lit("fingerprint"), "component").alias("key"))


def near_copies(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Rows (row, id, keep) of docs in groups of two or more; keep is the row of its group's smallest identifier.

    `row_col` (long) tells the rows of docs apart. Groups are the connected components of near copies; texts without
    words (null, empty, blank) are one group. Of rows with the smallest identifier the first stays; null identifiers
    come last. Texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = table(rows.mapInArrow(_sketch, "row long, id long, whole binary, shingles long, fp long, keys array<long>"))
    distinct = table(prints.groupBy("whole").agg(F.min("row").alias("node"), F.count("*").alias("rows"), F.first("shingles").alias("shingles"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = distinct.select("node", F.explode("keys").alias("key")).unionByName(table(fingerprint_keys(distinct)))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    # Bands with the same texts are one. Written first: then it is known whether the join below can do without a shuffle.
    once = table(shared.groupBy("n", "low", "members").agg(F.min("key").alias("key")).select("key", "n", "low"))
    # Most keys are their text's alone: a bounded filter clears them, so that the join shuffles the others.
    words = filter_words(once.count())
    likely = may_hold(keyed.withColumnRenamed("key", "id"), table(id_filter(once.select(F.col("key").alias("id")), words)), words)
    banded = table(likely.withColumnRenamed("id", "key").join(once, "key"))
    # What bands connect, directly or through others, meets as a whole: each text travels once.
    joint = components(banded.select(F.col("low").alias("src"), F.col("node").alias("dst")))
    joint = table(joint.join(distinct.select("node", "shingles"), "node"))
    sums = joint.groupBy("component").agg(F.count("*").alias("n"), F.sum("shingles").alias("weight"))
    large = table(sums.where((F.col("n") > BLOCK) | (F.col("weight") > WEIGHT)).select("component", _cut("n", "weight").alias("blocks")))
    some = not large.isEmpty()
    met = joint.join(carried(large), "component", "left_anti").select(F.col("component").alias("key"), F.lit(PLAIN).alias("part"), "node", F.col("node").alias("class"))
    if some:
        members = joint.join(carried(large), "component").select("node", "component", "shingles", "blocks")
        many = table(banded.select("key", "n", "node").join(members, "node"))
        met = met.unionByName(pivot_meetings(many))
    words = filter_words(joint.count())
    texts = may_hold(rows.select(F.col("row").alias("id"), "text"), table(id_filter(joint.select(F.col("node").alias("id")), words)), words).withColumnRenamed("id", "node")
    links = _links(texts, table(met), least)
    if some:
        links = table(links)
        links = links.unionByName(_links(texts, table(block_meetings(many.drop("component"), components(links))), least))
    found = table(components(links))
    # Texts that are alone, nearly all, go no further.
    named = table(distinct.join(found, "node", "left").where("rows > 1 or component is not null").select("whole", F.coalesce("component", "node").alias("component")))
    grouped = table(prints.select("row", "id", "whole").join(named, "whole").select("row", "id", "component"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("keep")
    kept = grouped.groupBy("component").agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    return grouped.join(kept, "component").select("row", "id", "keep")
