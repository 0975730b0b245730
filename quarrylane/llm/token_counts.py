"""Operator 4, token counts, by a compiled finite-state tokenizer.

Level one is the pre-token automaton (pretoken.py). Level two is a deterministic transducer over bytes, compiled from
the merges as texts ask for it. After each byte of a pre-token exactly one token can end there and stay apart from the
token before it. What decides this later are only the starts from which a token may still grow: how far back each lies,
the token that ends at it and the count there, relative to now. That is a state: it has no more of the past, so that
all prefixes that agree in it share it, there are finitely many, and a transition carries the change of the number of
tokens emitted. Outputs along a path add up to the path's count.

A long pre-token is cut into chunks. A chunk is a map from the state before it to the state after it and the count
between; maps compose associatively. Each chunk is run at once from the state that the bytes before it lead to, maps are
composed pairwise as in a prefix scan, and a chunk that is entered in another state than was foreseen is run again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.bpe import Memo, byte_characters
from quarrylane.llm.common import chunks
from quarrylane.llm.pretoken import SPACE, classes, split

#: Characters of a chunk.
CHUNK = 65_536
#: States, and pairs of tokens tried, that a worker remembers before it starts anew.
STATES = 200_000


class State:
    """Starts from which a token may grow, farthest first: (bytes back, token that ends there, count there less the count
    now). The farthest one's bytes are the window, what the state knows of the text."""

    __slots__ = ("window", "starts", "after")

    def __init__(self, window: bytes, starts: tuple):
        self.window, self.starts = window, starts
        self.after: dict[int, tuple[int, State]] = {}  # byte -> tokens emitted, next state


class Transducer:
    """Compiled from a byte-level BPE tokenizer file; count(word) runs it over one pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        raw = lambda piece: bytes(map(to_byte.__getitem__, piece))
        self.merges: dict[tuple[bytes, bytes], int] = {}
        for k, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[raw(a), raw(b)] = k
        self.tokens = {a + b for a, b in self.merges} | {bytes([b]) for b in range(256)}
        self.begun = {token[:k] for token in self.tokens for k in range(1, len(token))}
        self.longest = max(map(len, self.tokens))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[tuple, State] = {}
        self._restart()

    def _restart(self) -> None:
        for state in self.states.values():  # their cycles would keep them
            state.after.clear()
        self.states = {}
        self.root = self._state(b"", ((0, b"", 0),))

    def _state(self, window: bytes, starts: tuple) -> State:
        key = (window, starts)
        if (known := self.states.get(key)) is None:
            known = self.states[key] = State(window, starts)
        return known

    def _merge(self, parts: list[bytes]) -> list[bytes]:
        """The merges applied to parts, best first."""
        while len(parts) > 1:
            ranks = [self.merges.get(pair, 1 << 30) for pair in zip(parts, parts[1:], strict=False)]
            k = ranks.index(best := min(ranks))
            if best == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _stay(self, a: bytes, b: bytes) -> bool:
        """Does the text a + b have the encoding [a, b] (b alone, if a is empty)?"""
        if (known := self.apart.get((a, b))) is None:
            if len(self.apart) >= STATES:
                self.apart.clear()
            known = self.apart[a, b] = self._merge([bytes([x]) for x in a + b]) == [x for x in (a, b) if x]
        return known

    def _compile(self, state: State, byte: int) -> tuple[int, State]:
        """The transition from a state: only one token can end behind the byte, so the order of trials is free."""
        if len(self.states) >= STATES:
            self._restart()
        window, tokens = state.window + bytes([byte]), self.tokens
        size = len(window)
        for back, before, count in state.starts:
            last = window[size - 1 - back :]
            if last in tokens and self._stay(before, last):
                break
        emitted = count + 1
        starts = tuple((back + 1, before, count - emitted) for back, before, count in state.starts if window[size - 1 - back :] in self.begun)
        out = emitted, self._state(window[size - starts[0][0] :] if starts else b"", (*starts, (0, last, 0)))
        state.after[byte] = out
        return out

    def run(self, state: State, data: bytes) -> tuple[State, int]:
        """The state behind data, entered in a state, and the tokens emitted."""
        total, compiled = 0, self._compile
        for byte in data:
            emitted, state = state.after.get(byte) or compiled(state, byte)
            total += emitted
        return state, total

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        data = word.encode()
        if len(data) <= CHUNK:
            return self.run(self.root, data)[1]
        maps = [Map(self, data[k : k + CHUNK], data[max(0, k - self.longest) : k]) for k in range(0, len(data), CHUNK)]
        while len(maps) > 1:
            maps = [Composed(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0](self.root.window, self.root.starts)[2]


class Map:
    """What a chunk does: the state before it (window, starts) -> the state after it and the count between."""

    def __init__(self, transducer: Transducer, data: bytes, before: bytes):
        self.transducer, self.data, self.known = transducer, data, {}
        state, _ = transducer.run(transducer.root, before)  # foreseen from the bytes before; mostly it is the right one
        self(state.window, state.starts)

    def __call__(self, window: bytes, starts: tuple) -> tuple[bytes, tuple, int]:
        if (window, starts) not in self.known:
            state, count = self.transducer.run(self.transducer._state(window, starts), self.data)
            self.known[window, starts] = (state.window, state.starts, count)
        return self.known[window, starts]


class Composed:
    """The map of two chunks, one after the other; associative."""

    def __init__(self, left, right):
        self.left, self.right = left, right

    def __call__(self, window: bytes, starts: tuple) -> tuple[bytes, tuple, int]:
        *state, first = self.left(window, starts)
        *state, second = self.right(*state)
        return (*state, first + second)


class Counter:
    """Counts tokens of whole texts."""

    def __init__(self, path: str):
        self.transducer = Transducer(path)
        self.memo = Memo(self.transducer.count)

    def segments(self, texts: list[str]) -> np.ndarray:
        """Counts of texts without special strings."""
        words, counts = split(texts)
        each = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        total = np.concatenate(([0], np.cumsum(each)))
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]

    def scan(self, text: str) -> int:
        """The count of a long text, piece by piece, cut where a pre-token begins whatever is around it: where white space
        follows something else, or characters of two classes meet (an apostrophe may hold them together)."""
        total, at, rest = 0, 0, len(text)
        while at < rest:
            end = self._cut(text, at + CHUNK)
            total += int(self.segments([text[at:end]])[0])
            at = end
        return total

    def _cut(self, text: str, start: int) -> int:
        """The first sure boundary from `start` on, or the end; looked for in spans of growing length."""
        span = CHUNK
        while start < len(text):
            part = text[start - 1 : start + span]
            c = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            k = classes()[c]
            sure = (k[1:] != k[:-1]) & (k[:-1] != SPACE) & (c[:-1] != 39)
            if sure.any():
                return start + int(np.argmax(sure))
            start, span = start + span, span * 2
        return len(text)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings in it are one token each, as the library has it by default."""
        extra = [0] * len(texts)
        parts, owner, out = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            pieces = [text]
            for special in self.transducer.special:
                if special in text:
                    pieces = [x for piece in pieces for x in piece.split(special)]
            extra[k] = len(pieces) - 1
            for piece in pieces:
                if len(piece) > CHUNK:
                    extra[k] += self.scan(piece)
                elif piece:
                    parts.append(piece)
                    owner.append(k)
        if parts:
            np.add.at(out, owner, self.segments(parts))
        return (out + np.array(extra, np.int64)).tolist()


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) for each document, over its whole text.

    Null texts count as empty (zero tokens); identifiers may be null or repeated, each row has its own result; an empty
    table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for keys, texts in chunks(batches, "id", "text"):
            yield pa.record_batch({"id": pa.array(keys, pa.int64()), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()), "n_tokens": pa.array(own.counts(texts), pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document's bytes and tokens by the byte-level tokenizer, and whether it is over 1,024 tokens."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)
