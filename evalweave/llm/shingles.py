"""Hashed word shingles of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .common import keeps

#: Bytes of text that are hashed in one go (a longer text goes alone).
AT_ONCE = 1 << 19
U = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (public SplitMix64 constants)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Different values in order, by sorting (np.unique without counts hashes, which is slower for these)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, AT_ONCE + (AT_ONCE >> 2))
            up, down = np.full(n, U(BASE)), np.full(n, U(BASE_INVERSE))
            up[0] = down[0] = U(1)
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


POWERS = Powers()
keeps("shingles", POWERS.__init__)


def groups_of(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    some: list[bytes] = []
    size = 0
    for text in texts:
        some.append(data := (text or "").encode("utf-8", "surrogatepass"))
        size += len(data)
        if size >= AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def word_hashes(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower case A-Z) of all texts, and where each text's words begin (one more at the end)."""
    data = np.frombuffer(b" " + b" ".join(group) + b" ", np.uint8)
    space = SPACE[data]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = turn[0::2], turn[1::2]
    up, down = POWERS.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[LOWER[data]] * up[: len(data)], out=sums[1:])
    words = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))
    lengths = np.array([len(x) + 1 for x in group], np.int64)
    return words, np.searchsorted(begin, np.concatenate(([0], np.cumsum(lengths))) + 1, "left")


def shingle_sets(texts: Iterable[str | None], width: int = 3) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text of fewer words is one shingle, one of none has none."""
    for group in groups_of(texts):
        words, at = word_hashes(group)
        n = max(0, len(words) - width + 1)
        shingles = np.full(n, U(width))
        for k in range(width):
            shingles = mix(shingles + words[k : k + n])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                yield distinct(shingles[a : b - width + 1])
            elif b > a:
                one = np.full(1, U(b - a))
                for k in range(a, b):
                    one = mix(one + words[k : k + 1])
                yield one
            else:
                yield np.empty(0, U)
