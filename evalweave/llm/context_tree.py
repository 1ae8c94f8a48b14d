"""Context-tree weighting over bytes (Willems et al., 1995; byte decomposition as in CTW for text), with numpy.

A text is its UTF-8 bytes and the end byte 255, which UTF-8 never uses. A byte is eight binary decisions, each a node
(1 to 255) of the byte's binary tree. For every context of 0 to DEPTH bytes and every node, training counts zeros and
ones; a Krichevsky-Trofimov estimator turns them into a probability, and each context mixes its own estimate with its
longer contexts', half and half a priori: the weight of its own is half its block probability over the mixed one. The
trained tree is frozen, so a text's probability doesn't depend on other texts that are scored. A context that training
hasn't seen is no node of the tree, and the mix ends at the context above it.

The tree hangs together at contexts of TOP bytes and less. Below each TOP bytes it is computed from the grams with these
nearest bytes alone, and grams whose probability is asked for are laid among them with a count of 0, so that each level
is one sorted list and nothing is searched for. All nodes are kept. Empty lists give empty lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shingles import U

DEPTH, TOP = 6, 3
END = 255
LOG2 = np.log(2)
_LOG = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 1 << 16) - 0.5))))
_FACT = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1.0, 1 << 17)))))


def log_rising(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log of Gamma(n + shift) / Gamma(shift), by table or Stirling's series."""
    out = table[np.minimum(n, len(table) - 1)]
    large = np.flatnonzero(n >= len(table))
    if len(large):
        x = n[large] + shift
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - (0.5 * np.log(np.pi) if shift == 0.5 else 0.0)
    return out


def log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the KT probability of n0 zeros and n1 ones."""
    return log_rising(n0, _LOG, 0.5) + log_rising(n1, _LOG, 0.5) - log_rising(n0 + n1, _FACT, 1.0)


def grams_of(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes of all texts, with their ends, and where each text starts.

    A key holds the context, the nearest byte first, then the byte itself; bytes before a text are zero.
    """
    lead = bytes(DEPTH)
    data = np.frombuffer(b"".join(x for t in group for x in (lead, t, b"\xff")), np.uint8).astype(U)
    lengths = np.array([len(t) + 1 for t in group])
    n = len(data)
    key = data[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        key |= data[DEPTH - d : n - d] << U(8 * (DEPTH - d + 1))
    starts = np.cumsum(lengths + DEPTH) - lengths - DEPTH
    keep = np.ones(n - DEPTH, bool)
    for d in range(DEPTH):  # keys that end in the next text's lead
        keep[starts[1:] - DEPTH + d] = False
    return key[keep], np.cumsum(lengths) - lengths


def runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def mixed_with(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the mixed block probability, and the weight of the own one."""
    mixed = np.logaddexp(own, children) - LOG2
    return mixed, np.exp(own - LOG2 - mixed)


@dataclass
class Nodes:
    """For one decision of a byte at one depth: each pair's node, and the nodes' estimates, weights and presence."""

    of: np.ndarray
    one: np.ndarray
    weight: np.ndarray
    seen: np.ndarray


class Grams:
    """Different grams in order, with their training counts (0: only asked for), and the tree down to TOP bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        #: Pairs of context and byte, their counts by depth, and where a pair is among those one byte of context less.
        self.pairs, self.counts, self.above = {DEPTH: keys}, {DEPTH: counts.astype(np.int64)}, {}
        for depth in range(DEPTH - 1, TOP - 1, -1):
            pair = self.pairs[depth + 1]
            shorter = ((pair >> U(16)) << U(8)) | (pair & U(255))
            self.pairs[depth], at = np.unique(shorter, return_inverse=True)
            self.above[depth + 1] = at.ravel()
            self.counts[depth] = np.bincount(self.above[depth + 1], weights=self.counts[depth + 1], minlength=len(self.pairs[depth])).astype(np.int64)

    def nodes(self, bit: int):
        """Nodes of decision `bit` by depth; and names, zeros, ones and mixed log probabilities at TOP bytes."""
        out, below = {}, None
        for depth in range(DEPTH, TOP - 1, -1):
            name = self.pairs[depth] >> U(8 - bit)
            at = runs(name)
            of = np.zeros(len(name), np.int64)
            of[at[1:]] = 1
            of = np.cumsum(of)
            n = self.counts[depth]
            total = np.add.reduceat(n, at)
            ones = np.add.reduceat(n * ((self.pairs[depth] >> U(7 - bit)) & U(1)).astype(np.int64), at)
            own = log_block(total - ones, ones)
            if below is None:
                mixed, weight = own, np.ones(len(own))
            else:
                first, logs = below
                mixed, weight = mixed_with(own, np.bincount(of[self.above[depth + 1][first]], weights=logs, minlength=len(own)))
            out[depth] = Nodes(of, (ones + 0.5) / (total + 1), weight, total > 0)
            below = at, mixed
        node = ((U(1) << U(bit)) | ((self.pairs[TOP][at] & U(255)) >> U(8 - bit))).astype(U)
        return out, (((self.pairs[TOP][at] >> U(8)) << U(8)) | node, total - ones, ones, mixed)

    def partial(self) -> tuple[np.ndarray, ...]:
        """Sums for the nodes of TOP - 1 bytes of context: names, zeros, ones, mixed log probabilities of their children."""
        parts = [self.nodes(bit)[1] for bit in range(8)] if len(self.pairs[TOP]) else []
        if not parts:
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return shorter_sums(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    def log2(self, short: Short) -> np.ndarray:
        """log2 of the probability of each gram's byte after its context."""
        out = np.zeros(len(self.pairs[DEPTH]))
        if not len(out):
            return out
        top = self.pairs[TOP]
        for bit in range(8):
            nodes, _ = self.nodes(bit)
            state = short.walk(top, bit)
            for depth in range(TOP, DEPTH + 1):
                here = nodes[depth]
                if depth > TOP:
                    state = [x[self.above[depth]] for x in state]
                state = step(state, here.one[here.of], here.weight[here.of], here.seen[here.of])
            p = state[0] + state[1] * state[2]
            one = (self.pairs[DEPTH] >> U(7 - bit)) & U(1) > 0
            out += np.log2(np.clip(np.where(one, p, 1 - p), 1e-12, 1.0))
        return out


def step(state: list[np.ndarray], one: np.ndarray, weight: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
    """One byte of context more. state: probability so far, share left, estimate of the deepest context, whether the path goes on."""
    p, rest, last, going = state
    seen = seen & going
    ends = going & ~seen
    p = p + np.where(ends, rest * last, 0)  # the context above takes what is left
    share = np.where(seen, weight, 0)
    last = np.where(seen, one, last)
    p += rest * share * last
    return [p, np.where(ends, 0, rest * (1 - share)), last, seen]


def shorter_sums(name: np.ndarray, zeros: np.ndarray, ones: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums over nodes by the node with one byte of context less."""
    parent, at = np.unique(((name >> U(16)) << U(8)) | (name & U(255)), return_inverse=True)
    sums = [np.bincount(at.ravel(), weights=x, minlength=len(parent)) for x in (zeros, ones, mixed)]
    return parent, sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2]


class Short:
    """Nodes for contexts of fewer than TOP bytes, from sums for those of TOP - 1 bytes (at most 256^TOP rows)."""

    def __init__(self, name: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray):
        self.nodes = {}
        for depth in range(TOP - 1, -1, -1):
            order = np.argsort(name)
            name, zeros, ones, children = name[order], zeros[order], ones[order], children[order]
            mixed, weight = mixed_with(log_block(zeros, ones), children)
            self.nodes[depth] = name, (ones + 0.5) / (zeros + ones + 1), weight
            name, zeros, ones, children = shorter_sums(name, zeros, ones, mixed)

    def walk(self, pairs: np.ndarray, bit: int) -> list[np.ndarray]:
        """The state after the nodes for contexts of fewer than TOP bytes; pairs of TOP bytes of context and a byte."""
        n = len(pairs)
        state = [np.zeros(n), np.ones(n), np.full(n, 0.5), np.ones(n, bool)]
        node = (U(1) << U(bit)) | ((pairs & U(255)) >> U(8 - bit))
        for depth in range(TOP):
            names, one, weight = self.nodes[depth]
            name = ((pairs >> U(8 * (TOP - depth + 1))) << U(8)) | node
            if len(names):
                at = np.minimum(np.searchsorted(names, name), len(names) - 1)
                state = step(state, one[at], weight[at], names[at] == name)
            else:
                state = step(state, np.zeros(n), np.zeros(n), np.zeros(n, bool))
        return state
