"""Pre-tokens of the public byte-level vocabularies, cut for many texts at once.

The splitting pattern ('s|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces before a space or the end|spaces) is
a finite automaton over four character classes whose decisions depend on a character's neighbours alone. So it is run
as array operations over the code points of a whole batch.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return out


def split(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all texts one after the other, and how many each text has."""
    counts = np.zeros(len(texts), np.int64)
    whole = "".join(texts)
    n = len(whole)
    if not n:
        return [], counts
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    c = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    k = classes()[c]
    first = np.zeros(n + 1, bool)  # a text begins here
    first[0] = first[ends] = True
    space = k == SPACE
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    start[1:n] = (k[1:] != k[:-1]) | first[1:n]
    # From a run of spaces to something else: the last space stands alone, or goes with what follows if it is ' '.
    at = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) + 1
    start[at - 1] = True
    start[at[c[at - 1] == 32]] = False
    # 's, 't, 'm, 'd, 're, 've, 'll where a token begins with the apostrophe.
    quote = np.flatnonzero((c == 39) & start[:n])
    for size, tails in ((1, ("s", "t", "m", "d")), (2, ("re", "ve", "ll"))):
        q = quote[quote + size < n]
        same = np.ones(len(q), bool)
        for j in range(1, size + 1):
            same &= ~first[q + j]
        q = q[same]
        hit = np.zeros(len(q), bool)
        for tail in tails:
            hit |= np.logical_and.reduce([c[q + 1 + j] == ord(x) for j, x in enumerate(tail)])
        q = q[hit]
        start[q + 1] = False
        start[q + 1 + size] = True
    cut = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(cut, np.concatenate(([0], ends))))
    edges = cut.tolist()
    return [whole[a:b] for a, b in zip(edges, edges[1:], strict=False)], counts
