"""Operator 6, language-model scoring, over an Elias-Fano n-gram trie.

The model interpolates trigrams and bigrams with absolute discounting and unigrams with add-one:
p(w | u v) = max(c(u v w) - D, 0) / c(u v) + g(u v) * p(w | v), p(w | v) = max(c(v w) - D, 0) / c(v) + g(v) * p(w) and
p(w) = (c(w) + 1) / (N + V + 1); every pair and triple of training counts, and g is what keeps each sum at one. The
trie's first level has the words (sorted 64-bit hashes, Elias-Fano coded) with their counts; the second has, behind
Elias-Fano pointers that give each word's range, its followers' numbers, their counts, the quantised first summand and
each word's quantised g; the third the same for each pair, a follower w of u v by its place among the followers of v.
A follower is found by a successor search within its context's range.

Levels are cut into segments, ranges of the sorted keys (context, follower): files in the shared folder, written each
by one task and memory-mapped by the tasks that score. A level takes one shuffle: tasks sort and count their keys, cut
them at bounds taken from a sample (which only balances), and what arrives for a range is merged and written at once. A
context may go on over several segments, so that a frequent one is no task of its own.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.common import CHUNK_CHARS, chunks, shared_dir, table
from quarrylane.llm.elias_fano import EliasFano, Packed, _pack, dump, load, quantise, successor

DISCOUNT = 0.75
#: The least number of segments of a level, and the tokens of one beyond it.
SEGMENTS, ENTRIES = 32, 1 << 22
#: Keys that a task gathers before it passes them on; keys that bounds are taken from, about.
GATHER, SAMPLE = 4_000_000, 1 << 18
#: Bytes hashed, and tokens scored, at once.
BLOCK_BYTES, BLOCK_TOKENS = 1 << 22, 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240601).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
#: The hash that stands for a text's end (and, as a context, for its beginning).
END = np.uint64(0x5851F42D4C957F2D)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


@lru_cache(4)
def _at_least(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _POWER) | np.uint64(1)


def _multipliers(n: int) -> np.ndarray:
    """A multiplier for each place in a word, at least n of them. They are unrelated: powers of one number modulo 2^64 would
    give some long words (of Thue and Morse, say) one hash, whatever the number."""
    return _at_least(max(64, 1 << (n - 1).bit_length()))


def _hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of bytes that aren't white space, and where it begins. Runs go on from block to block."""
    hashes, starts, carry, length = [], [], 0, 0  # of the run that the last block ended in: its sum so far and length
    for k in range(0, len(b), BLOCK_BYTES):
        part = _LOWER[b[k : k + BLOCK_BYTES]]
        at = np.flatnonzero(~_WHITE[part])
        whole = len(at) and at[0] == 0 and length  # goes on from the last block
        if length and not whole:
            hashes.append(np.array([carry], np.uint64))
        if not len(at):
            carry = length = 0
            continue
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        sizes = np.diff(np.append(first, len(at)))
        place = np.arange(len(at)) - np.repeat(first, sizes)
        if whole:
            place[: sizes[0]] += length
        sums = np.add.reduceat(_RANDOM[part[at]] * _multipliers(int(place.max()) + 1)[place], first)
        if whole:
            sums[0] += np.uint64(carry)
        starts.append(at[first[1 if whole else 0 :]] + k)
        open_ = at[-1] == len(part) - 1
        length = (int(sizes[-1]) + (length if whole and len(first) == 1 else 0)) if open_ else 0
        carry = int(sums[-1]) if open_ else 0
        hashes.append(sums[:-1] if open_ else sums)
    if length:
        hashes.append(np.array([carry], np.uint64))
    none = np.zeros(0, np.int64)
    return _mixed(np.concatenate([none.astype(np.uint64), *hashes])), np.concatenate([none, *starts])


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For all texts END, the words' hashes, END; and each text's number of tokens (words and one end).

    Words are runs of anything but ASCII white space, A-Z lower-cased, told apart by a 64-bit hash of their bytes.
    """
    raw = [t.encode() for t in texts]
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    hashes, starts = _hashes(np.frombuffer(b"".join(x + b"\n" for x in raw), np.uint8))
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    out = np.full(len(hashes) + 2 * len(texts), END)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), counts) * 2 + 1] = hashes
    return out, counts + 1


def _tokens(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sequences each token stands (its context is before it), and whether it is its text's first."""
    total, begin = int(counts.sum()), np.cumsum(counts) - counts
    first = np.zeros(total, bool)
    first[begin] = True
    return np.arange(total) + np.cumsum(first), first


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{os.path.abspath(uri)}")


def _store(uri: str, data: bytes) -> None:
    """Write a file whole: a task that is tried again, or runs twice, replaces it."""
    fs, path = _file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{os.getpid()}.{np.random.default_rng().integers(1 << 60)}"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, path)


@lru_cache(4096)
def _segment(uri: str) -> dict:
    """A segment's arrays, memory-mapped; from a store that has no local path by way of a cached copy."""
    fs, path = _file_system(uri)
    if not isinstance(fs, pafs.LocalFileSystem):
        copy = os.path.join(tempfile.gettempdir(), path.replace("/", "_"))
        if not os.path.exists(copy):
            with fs.open_input_stream(path) as f, open(f"{copy}.{os.getpid()}", "wb") as out:
                out.write(f.read())
            os.replace(f"{copy}.{os.getpid()}", copy)
        path = copy
    a = load(np.memmap(path, np.uint8, "r"))
    if "before" in a:
        a["index"] = EliasFano(a["n"], a["width"], a["low"], a["high"], a["before"])
    for name in ("count", "child"):
        if name in a:
            a[name] = Packed(a[name], a[f"{name}_width"])
    return a


def _bits(top: int) -> int:
    return max(1, int(top).bit_length())


@dataclass
class Level:
    """The segments of pairs or triples, in order: each one's first key (context << split | follower), name and the
    number of its first entry; and the g of contexts that several segments share."""

    kind: str
    split: int
    firsts: np.ndarray
    names: list[int]
    offsets: np.ndarray
    shared: np.ndarray
    shared_g: np.ndarray

    def _each(self, key: np.ndarray) -> Iterator[tuple[int, slice, int]]:
        edges = np.append(np.searchsorted(key, self.firsts), len(key))
        for k, name in enumerate(self.names):
            if edges[k] < edges[k + 1]:
                yield int(self.offsets[k]), slice(edges[k], edges[k + 1]), name

    def find(self, path: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: none) and first summands of sorted keys."""
        number, out = np.full(len(key), -1), np.zeros(len(key))
        for offset, own, name in self._each(key):
            s = _segment(f"{path}/{self.kind}-{name}")
            context = (key[own] >> np.uint64(self.split)).astype(np.int64) - s["first"]
            live = np.flatnonzero(context < s["contexts"])
            context = context[live]
            at = successor(s["child"], s["index"].get(context), s["index"].get(context + 1), key[own][live] & np.uint64((1 << self.split) - 1))
            hit = at >= 0
            number[own.start + live[hit]] = offset + at[hit]
            out[own.start + live[hit]] = s["book"][s["code"][at[hit]]]
        return number, out

    def bases(self, path: str, context: np.ndarray) -> np.ndarray:
        """For each sorted context a number that none of its entries is below: where its range begins."""
        out = np.zeros(len(context), np.int64)
        for offset, own, name in self._each(context << np.uint64(self.split)):
            s = _segment(f"{path}/{self.kind}-{name}")
            out[own] = offset + s["index"].get(np.minimum(context[own].astype(np.int64) - s["first"], s["contexts"])).astype(np.int64)
        return out

    def backoff(self, path: str, context: np.ndarray) -> np.ndarray:
        """g of sorted contexts, one where a context has no entry."""
        out = np.ones(len(context))
        for _, own, name in self._each((context << np.uint64(self.split)) | np.uint64((1 << self.split) - 1)):
            s = _segment(f"{path}/{self.kind}-{name}")
            local = context[own].astype(np.int64) - s["first"]
            live = np.flatnonzero(local < s["contexts"])
            out[own.start + live] = s["g_book"][s["g_code"][local[live]]]
        if len(self.shared):
            at = np.minimum(np.searchsorted(self.shared, context), len(self.shared) - 1)
            out = np.where(self.shared[at] == context, self.shared_g[at], out)
        return out

    def counts(self, path: str, number: np.ndarray) -> np.ndarray:
        """Counts of sorted entry numbers."""
        out = np.zeros(len(number), np.int64)
        edges = np.searchsorted(number, self.offsets)
        for k, name in enumerate(self.names):
            a, b = edges[k], edges[k + 1]
            if a < b:
                out[a:b] = _segment(f"{path}/{self.kind}-{name}")["count"].get(number[a:b] - self.offsets[k]).astype(np.int64)
        return out


@dataclass
class Model:
    """Where the trie's segments are, and the corpus totals; a few bytes for each segment."""

    path: str
    shift: int  # bits of a word's number that are its place in its segment
    parts: int  # segments of the first level: a power of two
    total: int
    distinct: int
    filled: list[int]  # of those, the ones that have words
    two: Level | None = None
    three: Level | None = None

    @property
    def bits(self) -> int:
        """Bits of a word's number."""
        return self.shift + _bits(self.parts - 1)

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (-1: unknown), counts and g of sorted word hashes."""
        number, count = np.full(len(h), -1), np.zeros(len(h), np.int64)
        owner = (h >> np.uint64(64 - _bits(self.parts - 1))).astype(np.int64)
        edges = np.searchsorted(owner, np.arange(self.parts + 1))
        for p in self.filled:
            a, b = edges[p], edges[p + 1]
            if a < b:
                s = _segment(f"{self.path}/words-{p}")
                local = s["index"].find(h[a:b] & np.uint64((1 << (64 - _bits(self.parts - 1))) - 1))
                hit = np.flatnonzero(local >= 0)
                number[a + hit] = (p << self.shift) | local[hit]
                count[a + hit] = s["count"].get(local[hit]).astype(np.int64)
        g = np.ones(len(h))
        if self.two:
            known = np.flatnonzero(number >= 0)
            g[known] = self.two.backoff(self.path, number[known].astype(np.uint64))
        return number, count, g

    def pairs(self, pair: np.ndarray) -> np.ndarray:
        """The first summand of sorted pairs (context << bits | follower), zero where the trie hasn't one."""
        return self.two.find(self.path, pair)[1] if self.two else np.zeros(len(pair))

    def chained(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted pairs: numbers (-1: none), places among the first word's followers, first summands."""
        if not self.two:
            return np.full(len(pair), -1), np.zeros(len(pair), np.int64), np.zeros(len(pair))
        number, first = self.two.find(self.path, pair)
        context, back = np.unique(pair >> np.uint64(self.bits), return_inverse=True)
        return number, number - self.two.bases(self.path, context)[back], first

    def backoff(self, number: np.ndarray) -> np.ndarray:
        """g of pairs by their sorted numbers; one where no triple begins with the pair."""
        return self.three.backoff(self.path, number.astype(np.uint64)) if self.three else np.ones(len(number))

    def triples(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first summand of triples (pair's number, follower's place), zero where the trie hasn't one."""
        if not self.three:
            return np.zeros(len(number))
        key, back = np.unique(_joined(number, place, self.three.split), return_inverse=True)
        return self.three.find(self.path, key)[1][back]

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.distinct + 1))


def _joined(context: np.ndarray, follower: np.ndarray, split: int) -> np.ndarray:
    """Keys of contexts and followers; both are checked to have room."""
    if len(context) and (int(follower.max()) >> split or int(context.max()) >> (64 - split)):
        raise ValueError(f"a context and its follower do not fit into {64 - split} and {split} bits")
    return (context.astype(np.uint64) << np.uint64(split)) | follower.astype(np.uint64)


def in_training(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7)) != 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"h": pa.array(keys.view(np.int64)), "n": pa.array(n)})

    for (texts,) in chunks(batches, "text"):
        seq, counts = sequences(texts)
        held.append(np.unique(seq[_tokens(counts)[0]], return_counts=True))
        if len(held) >= 8 and sum(len(k) for k, _ in held) > GATHER:
            yield out(*merged())
            held = []
    if held:
        yield out(*merged())


def _build_words(path: str, parts: int):
    def build(key, group: pd.DataFrame) -> pd.DataFrame:
        keep = 64 - _bits(parts - 1)
        h = group["h"].to_numpy().view(np.uint64) & np.uint64((1 << keep) - 1)
        order = np.argsort(h)
        n = group["n"].to_numpy()[order].astype(np.uint64)
        width = _bits(n.max())
        _store(f"{path}/words-{key[0]}", dump(EliasFano.encode(h[order]) | {"count": _pack(n, width), "count_width": width}))
        return pd.DataFrame({"part": [key[0]], "entries": [len(h)]})

    return build


def _pairs(model: Model, seq: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The pair (context << bits | follower) of each token, all of whose words the model has."""
    word, inverse = np.unique(seq, return_inverse=True)
    number = model.words(word)[0][inverse]
    at, _ = _tokens(counts)
    return _joined(number[at - 1], number[at], model.bits)


def _triples(model: Model, seq: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The triple (pair's number << split | follower's place) of each token but a text's first, if the model has its pairs."""
    pair, back = np.unique(_pairs(model, seq, counts), return_inverse=True)
    number, place, _ = model.chained(pair)
    j = np.flatnonzero(~_tokens(counts)[1])
    context, own = back[j - 1], back[j]
    have = (number[context] >= 0) & (number[own] >= 0)
    return _joined(number[context[have]], place[own[have]], _split(model))


def _split(model: Model) -> int:
    """Bits that pairs' numbers leave to a follower's place."""
    return 64 - _bits(int(model.two.offsets[-1]))


_CODEC = pa.Codec("zstd", compression_level=1)


def _squeeze(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys (as steps) and counts in bytes: like bytes side by side, compressed."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (np.diff(key, prepend=np.uint64(0)).astype("<u8"), n.astype("<u4"))]
    return _CODEC.compress(b"".join(planes), asbytes=True)


def _unsqueeze(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(_CODEC.decompress(data, 12 * size, asbytes=True), np.uint8).reshape(12, size)
    step, n = (np.ascontiguousarray(x.T).reshape(-1).view(kind) for x, kind in ((planes[:8], "<u8"), (planes[8:], "<u4")))
    return np.cumsum(step, dtype=np.uint64), n.astype(np.int64)


def _gather(model: Model, bounds: np.ndarray, keys):
    """Keys (pairs or triples) with their counts in the task, by the range that they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            edges = np.append(np.searchsorted(key, bounds), len(key))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[s], edges[s + 1])
                yield pa.record_batch({"shard": pa.array([s], pa.int32()), "size": pa.array([edges[s + 1] - edges[s]], pa.int32()), "data": pa.array([_squeeze(key[own], n[own])], pa.binary())})

        for (texts,) in chunks(batches, "text"):
            held.append(keys(model, *sequences(texts)))
            if sum(map(len, held)) > GATHER:
                yield from flush()
                held = []
        if held:
            yield from flush()

    return run


def _sampled(model: Model, keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in chunks(batches, "text"):
            found = keys(model, *sequences(texts))
            yield pa.record_batch({"key": pa.array([found[:: 1 + len(found) // (1 << 14)].astype("<u8").tobytes()], pa.binary())})

    return run


def _bounds(model: Model, texts: DataFrame, shards: int, keys) -> np.ndarray:
    """Where to cut the keys into about `shards` ranges of as many tokens each; the first begins at zero."""
    rate = min(1.0, SAMPLE / max(model.total, 1))
    found = (texts if rate == 1 else texts.where(F.rand(11) < rate)).mapInArrow(_sampled(model, keys), "key binary").collect()  # about 8 bytes x SAMPLE
    sample = np.sort(np.concatenate([np.zeros(1, np.uint64), *(np.frombuffer(r.key, "<u8") for r in found)]))
    return np.unique(np.append(np.zeros(1, np.uint64), sample[np.arange(1, shards) * len(sample) // shards]))


def _context_counts(model: Model, number: np.ndarray) -> np.ndarray:
    """Counts of words by their (sorted) numbers."""
    out = np.zeros(len(number), np.int64)
    part = number >> model.shift
    for p in np.unique(part):
        own = part == p
        out[own] = _segment(f"{model.path}/words-{p}")["count"].get(number[own] & ((1 << model.shift) - 1)).astype(np.int64)
    return out


_BUILT = "name int, first long, entries long, low long, low_mass double, high long, high_mass double"


def _build(model: Model, kind: str, split: int, least: int, last: bool):
    """Merge what arrived for a range and write its segment; counts of entries only where a further level needs them."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = zip(*(_unsqueeze(data, size) for data, size in zip(group["data"], group["size"], strict=True)), strict=True)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, n = keys[new], np.add.reduceat(counts, new)
        keys, n = keys[n >= least], n[n >= least]
        if not len(keys):
            return pd.DataFrame({c.split()[0]: [] for c in _BUILT.split(", ")})
        context, follower = (keys >> np.uint64(split)).astype(np.int64), keys & np.uint64((1 << split) - 1)
        begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        own, first = context[begin], int(context[0])
        total = model.two.counts(model.path, own) if model.two else _context_counts(model, own)
        mass = np.add.reduceat(n - DISCOUNT, begin) / total
        pointers = np.searchsorted(context - first, np.arange(int(own[-1]) - first + 2)).astype(np.uint64)
        g = np.ones(len(pointers) - 1)
        g[own - first] = np.maximum(1 - mass, 1e-9)
        code, book = quantise((n - DISCOUNT) / np.repeat(total, np.diff(np.append(begin, len(keys)))))
        g_code, g_book = quantise(g)
        width = _bits(follower.max())
        arrays = EliasFano.encode(pointers) | {"first": first, "contexts": len(pointers) - 1, "child": _pack(follower, width), "child_width": width, "code": code, "book": book, "g_code": g_code, "g_book": g_book}
        if not last:
            most = _bits(n.max())
            arrays |= {"count": _pack(n.astype(np.uint64), most), "count_width": most}
        _store(f"{model.path}/{kind}-{key[0]}", dump(arrays))
        return pd.DataFrame({"name": [key[0]], "first": keys[:1].view(np.int64), "entries": [len(n)], "low": own[:1], "low_mass": mass[:1], "high": own[-1:], "high_mass": mass[-1:]})

    return run


def _level(model: Model, texts: DataFrame, kind: str, split: int, keys, least: int, last: bool) -> Level | None:
    """Count the keys of texts and write the level's segments."""
    shards = max(SEGMENTS, _power(-(-model.total // ENTRIES)))
    bounds = _bounds(model, texts, shards, keys)
    gathered = texts.mapInArrow(_gather(model, bounds, keys), "shard int, size int, data binary").repartition(2 * shards, "shard")
    built = sorted(gathered.groupBy("shard").applyInPandas(_build(model, kind, split, least, last), _BUILT).collect(), key=lambda r: r.name)
    if not built:
        return None
    shares: dict[int, list[float]] = {}  # of contexts at the segments' edges, the only ones that several may share
    for r in built:
        for context, mass in {r.low: r.low_mass, r.high: r.high_mass}.items():
            shares.setdefault(context, []).append(mass)
    shared = sorted((c, max(1 - sum(m), 1e-9)) for c, m in shares.items() if len(m) > 1)
    firsts, offsets = np.array([r["first"] for r in built], np.int64).view(np.uint64), np.concatenate(([0], np.cumsum([r.entries for r in built], dtype=np.int64)))
    return Level(kind, split, firsts, [r.name for r in built], offsets, np.array([c for c, _ in shared], np.uint64), np.array([g for _, g in shared]))


def _power(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def train(docs: DataFrame, text_col: str = "text", order: int = 3, least: int = 1) -> Model:
    """The trie over all rows of docs; counts cover every row and whole texts, null texts count as empty.

    `order` is 1, 2 or 3 words; pairs and triples seen fewer than `least` times are left out (by default none is).
    """
    if order not in (1, 2, 3):
        raise ValueError("order is 1, 2 or 3")
    spark = docs.sparkSession
    path = shared_dir(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    words = table(texts.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = max(SEGMENTS, _power(-(-distinct // ENTRIES)))
    part = F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - _bits(parts - 1)))
    built = words.groupBy(part.cast("int").alias("part")).applyInPandas(_build_words(path, parts), "part int, entries long").collect()
    model = Model(path, _bits(max([r.entries for r in built], default=1)), parts, int(total), int(distinct), sorted(r.part for r in built))
    if model.bits > 32:
        raise ValueError("words are numbered in 32 bits")
    if distinct and order > 1:
        model.two = _level(model, texts, "pairs", model.bits, _pairs, least, order == 2)
    if model.two and order > 2:
        model.three = _level(model, texts, "triples", _split(model), _triples, least, True)
    return model


def _chances(model: Model, seq: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens at `at` (`first`: their text's first): whether each is known, log10 of its base and of its chance."""
    word, inverse = np.unique(np.concatenate([seq[at], seq[at - 1], seq[np.maximum(at - 2, 0)]]), return_inverse=True)
    number, count, g = model.words(word)
    w, v, u = inverse.reshape(3, -1)
    base = model.base(count)
    # Pairs of all tokens and of the words before them, looked up together.
    left, right = np.concatenate([v, u]), np.concatenate([w, v])
    known = np.flatnonzero((number[left] >= 0) & (number[right] >= 0))
    pair, back = np.unique(_joined(number[left[known]], number[right[known]], model.bits), return_inverse=True)
    found, spot, summand = model.chained(pair)
    entry, place, own = np.full(len(left), -1), np.full(len(left), -1), np.zeros(len(left))
    entry[known], place[known], own[known] = found[back], spot[back], summand[back]
    n = len(w)
    chance = own[:n] + g[v] * 10.0 ** base[w]
    j = np.flatnonzero(~first & (entry[n:] >= 0))
    context, back = np.unique(entry[n + j], return_inverse=True)
    chance[j] *= model.backoff(context)[back]
    j = j[entry[j] >= 0]
    chance[j] += model.triples(entry[n + j], place[j])
    return count[w] > 0, base[w], np.log10(chance)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, base_score, score) for each document, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches, "id", "text", size=4 * CHUNK_CHARS):
            seq, counts = sequences(texts)
            at, first = _tokens(counts)
            owner = np.repeat(np.arange(len(texts)), counts)
            sums = np.zeros((3, len(texts)))
            for k in range(0, len(at), BLOCK_TOKENS):
                own = slice(k, k + BLOCK_TOKENS)
                for total, values in zip(sums, _chances(model, seq, at[own], first[own]), strict=True):
                    total += np.bincount(owner[own], values, len(texts))
            yield pa.record_batch({"id": pa.array(keys, pa.int64()), "n_tokens": pa.array(counts), "n_known": pa.array(sums[0].astype(np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_col)


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, least: int = 1) -> DataFrame:
    """Train on the rows whose crc32(id) mod 7 is not 2 and score all rows.

    Adds held_out and train_tokens. A null identifier is neither held out nor learned from; null texts count as empty
    (one token, the end); repeated rows each count and have a result; without training rows every probability is one;
    an empty table gives no rows; other columns are ignored.
    """
    model = train(docs.where(in_training(id_col)), text_col, order, least)
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7)) == 2, F.lit(False))
    return score(docs, model, id_col, text_col).select(id_col, held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's unigram base score and model score."""
    return score_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))
