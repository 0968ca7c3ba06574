"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of alphanumeric characters of the lower-cased text. Hashes do not depend on
the process, so that they can be compared across executors.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Characters that are hashed in one go; longer texts are one block each.
BLOCK = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works in place on a copy."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x10000)), bool, 0x10000)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def block_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the number of words of each text."""
    texts = [t.lower() for t in texts]
    c = codes("\n".join(texts))
    return hashed_runs(c, _alnum()[np.minimum(c, 0xFFFF)] | (c > 0xFFFF), [len(t) for t in texts])


def blank_split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for words that are whatever stands between ASCII blanks, with only A-Z lower-cased."""
    c = codes("\n".join(texts))
    c = np.where((c >= ord("A")) & (c <= ord("Z")), c + np.uint32(32), c)
    return hashed_runs(c, (c != 32) & ((c < 9) | (c > 13)), [len(t) for t in texts])


def hashed_runs(c: np.ndarray, inside: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of characters that are inside, and how many begin in each of the texts, which
    have these lengths and one character between them."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(c) + 1)
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c + np.uint64(1)) * up[: len(c)], out=total[1:])
    last = np.cumsum(np.array(lengths, np.int64) + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, last))))
    return mix((total[ends] - total[starts]) * down[starts]), counts


def word_blocks(texts: list[str | None], split: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] = block_words) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (first, last, hashes, counts) of consecutive texts[first:last]; null counts as empty."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > BLOCK:
            yield first, k, *split([x or "" for x in texts[first:k]])
            first, size = k, 0
        size += n
    if first < len(texts):
        yield first, len(texts), *split([x or "" for x in texts[first:]])
