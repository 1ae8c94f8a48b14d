"""Places of the seeded Mersenne twister (MT19937): a generator set to any place without the numbers before it.

The twister is linear over two elements, so n steps are a polynomial of its step: x^n modulo the step's minimal
polynomial, which the output bits of one generator give (Berlekamp and Massey). A jump costs the same for any n but for its
logarithm.
"""

from __future__ import annotations

import functools

import numpy as np

#: Words of state, distance of the word mixed in, bits of the state, the twist, and the mask of the upper bit.
WORDS, MIDDLE, DEGREE, TWIST, UPPER = 624, 397, 19937, 0x9908B0DF, 0x80000000


def seeded(seed: int) -> np.random.RandomState:
    return np.random.RandomState([seed])


@functools.cache
def minimal_polynomial() -> int:
    """Bits are coefficients; found from twice as many output bits as it has degrees."""
    source = np.random.RandomState(1)
    bits = (source.randint(0, 2**32, 2 * DEGREE, dtype=np.uint32) & 1).tolist()
    # The reversed connection polynomial c of the sequence; seen holds the newest bit in place 0.
    c, b, length, since, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = (seen << 1) | bit
        if (c & seen).bit_count() & 1:
            if 2 * length <= n:
                c, b, length, since = c ^ (b << since), c, n + 1 - length, 1
                continue
            c ^= b << since
        since += 1
    assert length == DEGREE
    return int(format(c, f"0{DEGREE + 1}b")[::-1], 2)


@functools.cache
def lower_terms() -> tuple[int, ...]:
    p = minimal_polynomial() ^ (1 << DEGREE)
    return tuple(i for i in range(DEGREE) if p >> i & 1)


def reduced(p: int) -> int:
    while high := p >> DEGREE:
        p &= (1 << DEGREE) - 1
        for i in lower_terms():
            p ^= high << i
    return p


SPREAD = [sum((v >> i & 1) << 2 * i for i in range(8)).to_bytes(2, "little") for v in range(256)]


def squared(p: int) -> int:
    """Squares of polynomials over two elements have a zero between any two coefficients."""
    return int.from_bytes(b"".join(map(SPREAD.__getitem__, p.to_bytes(-(-p.bit_length() // 8) or 1, "little"))), "little")


def power(n: int) -> int:
    """x^n modulo the minimal polynomial."""
    p = 1
    for bit in format(n, "b"):
        p = reduced(squared(p))
        if bit == "1":
            p = reduced(p << 1)
    return p


def jumped(key: np.ndarray, words: int) -> np.ndarray:
    """The window of 624 words that begins `words` later, but for the lower bits of its first word, which nothing uses."""
    if not words:
        return key
    at = power(words)
    start = [int(x) for x in key]
    # Horner's scheme: step what is there, then add the start where the coefficient is one. A ring holds the window.
    ring, first = np.zeros(WORDS, np.uint32), 0
    begin = np.array(start, np.uint32)
    for i in range(at.bit_length() - 1, -1, -1):
        y = (int(ring[first]) & UPPER) | (int(ring[(first + 1) % WORDS]) & (UPPER - 1))
        ring[first] = int(ring[(first + MIDDLE) % WORDS]) ^ (y >> 1) ^ (TWIST if y & 1 else 0)
        first = (first + 1) % WORDS
        if at >> i & 1:
            ring[first:] ^= begin[: WORDS - first]
            ring[:first] ^= begin[WORDS - first :]
    return np.concatenate((ring[first:], ring[:first]))


def at_place(seed: int, doubles: int) -> np.random.RandomState:
    """A generator whose next random number is number `doubles` (from 0) of the seeded sequence; each takes two words."""
    source = seeded(seed)
    kind, key, place, *rest = source.get_state()
    assert place == WORDS
    source.set_state((kind, jumped(key, 2 * doubles), WORDS, *rest))
    return source
