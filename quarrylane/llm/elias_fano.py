"""Compact integer arrays that are read in place: packed fixed-width integers and Elias-Fano monotone sequences."""

from __future__ import annotations

import json

import numpy as np

_U = np.uint64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value one after the other (8 spare bytes behind, for whole-word reads)."""
    if not width or not len(values):
        return np.zeros(8, np.uint8)
    parts = []
    for k in range(0, len(values), 1 << 16):  # 2 ** 16 values end on a byte whatever the width
        bits = np.unpackbits(values[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=width)
        parts.append(np.packbits(bits.reshape(-1), bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


class Packed:
    """Fixed-width integers of up to 56 bits."""

    def __init__(self, data: np.ndarray, width: int):
        self.width, self.mask = width, _U((1 << width) - 1)
        self.words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # a word from every byte on

    def get(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        at = i * self.width
        return (self.words[at >> 3] >> (at & 7).astype(_U)) & self.mask


class EliasFano:
    """A monotone sequence: low bits packed, high parts in unary, with the ones before each word of it."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, Packed(low, width), high, before
        self.zeros = np.arange(len(before), dtype=np.int64) * 64 - before

    @staticmethod
    def encode(values: np.ndarray) -> dict:
        """Arrays and numbers of the encoding of sorted unsigned values."""
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        high = (values >> _U(width)).astype(np.int64) + np.arange(n)
        size = (top >> width) + n + 1
        bits = np.zeros((size + 63) // 64 * 64, bool)
        bits[high] = True
        words = np.packbits(bits, bitorder="little").view("<u8")
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
        return {"n": n, "width": width, "low": _pack(values, width), "high": words, "before": before}

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """Where the i-th one (or zero) stands."""
        count = self.ones if ones else self.zeros
        w = np.minimum(np.searchsorted(count, i, "right") - 1, len(self.high) - 1)
        word = self.high[w] if ones else ~self.high[w]
        r, at = i - count[w], w.astype(np.int64) * 64
        for step in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(word & _U((1 << step) - 1)).astype(np.int64)
            go = r >= c
            r = r - np.where(go, c, 0)
            at += go * step
            word = np.where(go, word >> _U(step), word)
        return at

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return ((self._select(i, True) - i).astype(_U) << _U(self.width)) | self.low.get(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The places of values x, -1 where the sequence hasn't one."""
        if not self.n:
            return np.full(len(x), -1)
        h = (x >> _U(self.width)).astype(np.int64)
        inside = h < self.zeros[-1]
        h = np.where(inside, h, 0)
        hi = self._select(h, False) - h
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        at = successor(self.low, np.where(inside, lo, 0), np.where(inside, hi, 0), x & self.low.mask)
        return at


def successor(values: Packed, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """In each sorted range [lo, hi) of values the place of x, -1 where it hasn't x: the first not less is sought."""
    lo, end = lo.astype(np.int64).copy(), hi.astype(np.int64)
    hi = end.copy()
    busy = np.flatnonzero(lo < hi)
    while len(busy):
        mid = (lo[busy] + hi[busy]) >> 1
        less = values.get(mid) < x[busy]
        lo[busy] = np.where(less, mid + 1, lo[busy])
        hi[busy] = np.where(less, hi[busy], mid)
        busy = busy[lo[busy] < hi[busy]]
    out = np.full(len(lo), -1)
    near = np.flatnonzero(lo < end)
    same = values.get(lo[near]) == x[near]
    out[near[same]] = lo[near[same]]
    return out


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of 8 bits and their codebook: means of at most 256 classes, cut for half by count and for half by distinct values.

    Where most values are the same, cuts by count alone would leave few classes to the others.
    """
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    distinct = np.unique(values)
    if len(distinct) <= 256:
        return np.searchsorted(distinct, values).astype(np.uint8), distinct.astype(np.float32)
    edges = np.unique(np.concatenate([np.quantile(values, np.linspace(0, 1, 129)[1:-1]), np.quantile(distinct, np.linspace(0, 1, 130)[1:-1])]))
    code = np.searchsorted(edges, values, "left")
    n = np.bincount(code, minlength=len(edges) + 1)
    return code.astype(np.uint8), (np.bincount(code, values, len(edges) + 1) / np.maximum(n, 1)).astype(np.float32)


def dump(arrays: dict) -> bytes:
    """Named arrays and numbers as one block: a JSON head, then the arrays at multiples of 64 bytes."""
    head, blocks, at = {}, [], 0
    for name, value in arrays.items():
        if isinstance(value, np.ndarray):
            raw = np.ascontiguousarray(value).tobytes()
            head[name] = [value.dtype.str, len(value), at]
            pad = -len(raw) % 64
            blocks += [raw, bytes(pad)]
            at += len(raw) + pad
        else:
            head[name] = value
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return b"".join([len(text).to_bytes(8, "little"), text, *blocks])


def load(block: np.ndarray) -> dict:
    """What dump() wrote, over a (memory-mapped) byte array, without a copy."""
    size = int.from_bytes(block[:8].tobytes(), "little")
    head = json.loads(block[8 : 8 + size].tobytes())
    base = 8 + size
    return {k: np.ndarray((v[1],), v[0], block, base + v[2]) if isinstance(v, list) else v for k, v in head.items()}
