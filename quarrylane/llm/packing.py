"""Operator 8, packing token sequences, by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's tokens are cut into whole windows as long as they
fill one, and the rest goes to the open window that it leaves fullest. When none has room, the fullest is topped up
with a piece of what came (if its gap is worth a cut) and emitted, and a new window opens. At a partition's end the
open windows are left over; those of neighbouring partitions are merged, again best fit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.bpe import encode_packed, specials
from quarrylane.llm.common import SMALL_CHARS, chunks, table

#: Open windows of a partition; the gap from which on an incoming text is cut to fill it; partitions merged together.
OPEN, WORTH, FAN_IN = 16, 8, 16
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, window long, offset long, open boolean"


class Packer:
    """The open windows of one partition; add() returns the pieces that it placed, rows of PIECES in order.

    Pieces of a window come out when it closes, so that whether it was left open is known.
    """

    def __init__(self, size: int, part: int, limit: int = OPEN):
        self.size, self.part, self.limit, self.made = size, part, limit, 0
        self.windows: list[tuple[int, int, list]] = []  # (fill, number, pieces)

    def _close(self, k: int) -> list[tuple]:
        _, number, pieces = self.windows.pop(k)
        return [(*x, self.part, number, offset, False) for x, offset in pieces]

    def _put(self, k: int, piece: tuple) -> list[tuple]:
        fill, number, pieces = self.windows[k]
        pieces.append((piece, fill))
        self.windows[k] = (fill + piece[2], number, pieces)
        return self._close(k) if fill + piece[2] == self.size else []

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        total, start, out = len(ids) // 4, 0, []

        def piece(n: int) -> tuple:
            nonlocal start
            start += n
            return (doc_id, start - n, n, zlib.crc32(ids[4 * (start - n) : 4 * start]), total)

        while start < total:
            left = total - start
            if left >= self.size:
                out.append((*piece(self.size), self.part, self.made, 0, False))
                self.made += 1
                continue
            fits = [(fill, k) for k, (fill, _, _) in enumerate(self.windows) if fill + left <= self.size]
            if fits:
                out += self._put(max(fits)[1], piece(left))
            elif len(self.windows) < self.limit:
                self.windows.append((0, self.made, []))
                self.made += 1
                out += self._put(len(self.windows) - 1, piece(left))
            else:
                fill, k = max((fill, k) for k, (fill, _, _) in enumerate(self.windows))
                out += self._put(k, piece(self.size - fill)) if self.size - fill >= WORTH else self._close(k)
        return out

    def leftovers(self) -> list[tuple]:
        return [(*x, self.part, number, offset, True) for _, number, pieces in self.windows for x, offset in pieces]


def _ids(texts: list[str], path: str) -> Iterator[bytes]:
    """Each text's ids and the end's id. A special string in a text is its one id, as the library has it by default."""
    known = specials(path)
    cut = re.compile("|".join(map(re.escape, sorted(known, key=len, reverse=True))) or r"(?!)")
    pieces = [cut.split(text) for text in texts]
    between = [[np.array([known[m]], "<u4").tobytes() for m in cut.findall(text)] for text in texts]
    flat, end = encode_packed([x for each in pieces for x in each], path), np.array([END_ID], "<u4").tobytes()
    for each, marks in zip(pieces, between, strict=True):
        yield b"".join(x for _, mark in zip(each, [*marks, end], strict=True) for x in (next(flat), mark))


def _merge(leftovers: pd.DataFrame, size: int) -> pd.DataFrame:
    """Windows left over by neighbouring partitions put together, fullest first, each where it leaves least room."""
    bins: list[list] = []  # [fill, part, window]
    fills = leftovers.groupby(["part", "window"], sort=True)["length"].sum()
    moved = {}
    for (part, window), fill in sorted(fills.items(), key=lambda x: (-x[1], x[0])):
        fit = max((b for b in bins if b[0] + fill <= size), default=None, key=lambda b: b[0])
        if fit is None:
            bins.append(fit := [0, part, window])
        moved[part, window] = (fit[1], fit[2], fit[0])
        fit[0] += fill
    target = [moved[x] for x in zip(leftovers["part"], leftovers["window"], strict=True)]
    leftovers["offset"] += [t[2] for t in target]
    leftovers["part"], leftovers["window"] = [t[0] for t in target], [t[1] for t in target]
    leftovers["open"] = False
    return leftovers


def pack(docs: DataFrame, path: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    A document is its token ids by the vocabulary at `path` (a tokenizer's JSON or a rank file) and then id 0; each id lies in exactly one piece, pieces of
    a sequence have offsets without gaps from 0 and at most `size` ids together. Null texts count as empty: one piece,
    the end's id. Rows with a null or repeated identifier are packed each. An empty table gives no rows; other columns
    are ignored. The placed pieces are a table in the shared folder, so that a lost executor costs its partitions only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, TaskContext.get().partitionId())
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("part", pa.int32()), ("window", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for keys, texts in chunks(batches, "id", "text", size=SMALL_CHARS):
            rows = [row for key, ids in zip(keys, _ids(texts, path), strict=True) for row in packer.add(key, ids)]
            if rows:
                yield batch(rows)
        if rows := packer.leftovers():
            yield batch(rows)

    placed = table(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES))
    left = placed.where("open").groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(lambda x: _merge(x, size), PIECES)
    return placed.where("not open").unionByName(left).select(
        F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.shiftleft(F.col("part").cast("long"), 40) + F.col("window")).alias("sequence_id"), "offset",
    )


def op8_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents packed into sequences of at most 1,024 tokens."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)
