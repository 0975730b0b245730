"""Operator 3, byte-level BPE encoding and decoding through a sentencepiece model serialised from the vocabulary.

A rank file becomes a sentencepiece BPE model without training: each token's bytes are mapped to printable characters,
its score is its negative rank (so that merges happen in the order of ranks), and the normaliser is the identity.
Pre-tokens are encoded one by one; decoding looks the tokens' bytes up by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.common import MEMORIES, chunks
from quarrylane.llm.pretoken import split

#: Pre-tokens whose encoding a worker remembers, and the longest that it does; then it begins anew.
CACHE_WORDS, CACHE_CHARS = 250_000, 64
#: The special string of the vocabulary that comes as a rank file too.
SPECIALS = {"<|endoftext|>": 50256}


@lru_cache(1)
def byte_characters() -> str:
    """The character that stands for each byte: itself where printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(spare)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, or of a byte-level BPE tokenizer's JSON, in the order of their ranks, which are 0, 1, 2, ..."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        apart, to_byte = {x["content"] for x in spec["added_tokens"]}, {c: b for b, c in enumerate(byte_characters())}
        pairs = sorted((rank, bytes(map(to_byte.__getitem__, token))) for token, rank in spec["model"]["vocab"].items() if token not in apart)
        merged = [bytes(map(to_byte.__getitem__, "".join(m.split(" ") if isinstance(m, str) else m))) for m in spec["model"]["merges"]]
        if [token for _, token in pairs[len(pairs) - len(merged) :]] != merged:
            raise ValueError(f"{path}: merges are not in the order of their ranks")
    else:
        with open(path, "rb") as f:
            pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks have gaps")
    return [token for _, token in pairs]


@lru_cache(2)
def specials(path: str) -> dict[str, int]:
    """Special strings and their ids: a tokenizer's own; a rank file has none in it, so that those of SPECIALS count."""
    if not path.endswith(".json"):
        return SPECIALS
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece k is tokens[k]; an unknown piece follows as the last."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    model, chars = schema.ModelProto(), byte_characters()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(map(chars.__getitem__, token)), score=-rank, type=schema.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0, type=schema.ModelProto.SentencePiece.UNKNOWN)
    spec, norm = model.trainer_spec, model.normalizer_spec
    spec.model_type, spec.vocab_size, spec.byte_fallback = schema.TrainerSpec.BPE, len(tokens) + 1, False
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(tokens), -1, -1, -1
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes pre-tokens to ids and decodes ids to bytes, by one rank file."""

    def __init__(self, path: str):
        self.tokens = read_ranks(path)
        self.whole = {token.decode("latin-1"): rank for rank, token in enumerate(self.tokens)}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.mapped = {b: c for b, c in enumerate(byte_characters())}

    def word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        raw = word.encode().decode("latin-1")
        known = self.whole.get(raw)
        return [known] if known is not None else self.processor.EncodeAsIds(raw.translate(self.mapped))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


class Memo(dict):
    """word -> make(word), remembered for short words up to a bound that holds memory flat."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


@lru_cache(2)
def packed_words(path: str) -> Memo:
    """Pre-token -> its ids as little-endian 32-bit integers in bytes."""
    own = codec(path)
    return Memo(lambda word: np.array(own.word(word), "<u4").tobytes())


MEMORIES += [packed_words.cache_clear, codec.cache_clear]


def encode_packed(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian 32-bit integers."""
    words, counts = split(texts)
    at, ids = 0, packed_words(path).__getitem__
    for n in counts.tolist():
        yield b"".join(map(ids, words[at : at + n]))
        at += n


def encode(texts: list[str], path: str) -> Iterator[list[int]]:
    """The ids of each text."""
    for packed in encode_packed(texts, path):
        yield np.frombuffer(packed, "<u4").tolist()


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>) for each document, whole text; null is empty and has an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches, "id", "text"):
            yield pa.record_batch({"id": pa.array(keys, pa.int64()), "ids": pa.array(encode(texts, path), pa.list_(pa.int32()))})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_table(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, decoded binary); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            yield pa.record_batch({"id": batch.column("id"), "decoded": pa.array([None if x is None else own.decode(x) for x in lists], pa.binary())})

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each document in one pass: rows (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Null texts count as empty (no ids); identifiers may be null or repeated, each row has its own result; an empty
    table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for keys, texts in chunks(batches, "id", "text"):
            n, ids_sha, decoded_sha = [], [], []
            for ids in encode(texts, path):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.record_batch({"id": pa.array(keys, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(decoded_sha)})

    return (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document encoded by the byte-level vocabulary's ranks, and decoded again."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)
