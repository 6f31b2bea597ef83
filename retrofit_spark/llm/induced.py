"""Induced suffix sorting with bucket queues that go to disk.

Suffixes that start at an S* position (smaller than the next one, larger or equal before) are sorted
first; from them the L suffixes follow in one ascending pass over the buckets of first symbols, and from
those the S suffixes in one descending pass. Each bucket has a first-in-first-out queue; queues are filled
in sorted order only, so together they work as the priority queue of an external induced sort, and
what they hold beyond a bound goes to a temporary file. A pass takes a bucket's whole queue at a
time in numpy; suffixes that fall into the bucket they come from are further rounds of it.

Matches of a given length are asked for, so the order is needed to that depth only: S* suffixes are
sorted by their first DEPTH symbols, which takes the place of the recursion on S* names, and each
induction adds a symbol to what is known. Common prefixes of neighbours are read off the sorted order.
"""

from __future__ import annotations

import tempfile

import numpy as np

DEPTH, PER_WORD, HELD_BYTES = 56, 7, 16 << 20


class DiskQueue:
    """Positions first in, first out; what exceeds the shared bound is kept in a temporary file."""

    held = 0

    def __init__(self):
        self.parts, self.file, self.spilled = [], None, 0

    def push(self, positions: np.ndarray) -> None:
        if not len(positions):
            return
        if DiskQueue.held + positions.nbytes > HELD_BYTES:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            for part in self.parts:
                DiskQueue.held -= part.nbytes
                self.file.write(part.tobytes())
            self.parts = []
            self.file.write(positions.astype(np.int64).tobytes())
        else:
            self.parts.append(positions.astype(np.int64))
            DiskQueue.held += positions.nbytes

    def take(self) -> np.ndarray:
        """All positions in the order they came in; the queue is empty then."""
        out = []
        if self.file is not None:
            self.file.seek(0)
            out.append(np.frombuffer(self.file.read(), np.int64))
            self.file.close()
            self.file = None
        for part in self.parts:
            DiskQueue.held -= part.nbytes
            out.append(part)
        self.parts = []
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _deal(queues: list[DiskQueue], symbols: np.ndarray, positions: np.ndarray) -> None:
    """Positions to the queues of their symbols, in order."""
    order = np.argsort(symbols, kind="stable")
    symbols, positions = symbols[order], positions[order]
    edges = np.flatnonzero(np.diff(symbols)) + 1
    for part in np.split(np.arange(len(symbols)), edges):
        if len(part):
            queues[symbols[part[0]]].push(positions[part])


def prefix_words(symbols: np.ndarray, at: np.ndarray, depth: int = DEPTH):
    """The first `depth` symbols of suffixes, seven to a word; `symbols` (below 512) must reach that far beyond each."""
    for j in range(0, depth, PER_WORD):
        word = np.zeros(len(at), np.uint64)
        for t in range(PER_WORD):
            word <<= np.uint64(9)
            if j + t < depth:
                word |= symbols[at + (j + t)].astype(np.uint64)
        yield word


def suffix_types(symbols: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last one is S."""
    n = len(symbols)
    change = np.flatnonzero(symbols[:-1] != symbols[1:])
    run = np.searchsorted(change, np.arange(n))
    small = np.ones(n, bool)
    inside = run < len(change)
    at = change[run[inside]]
    small[inside] = symbols[at] < symbols[at + 1]
    return small


def sort_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes, sorted by their first DEPTH symbols at least. Symbols are below 257; the last one is 0."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(DEPTH, symbols.dtype)])
    small = suffix_types(symbols)
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    star = star[np.lexsort(list(prefix_words(padded, star))[::-1])]
    star_edges = np.searchsorted(symbols[star], np.arange(258))
    alphabet = 257
    larges, queues = [DiskQueue() for _ in range(alphabet)], [DiskQueue() for _ in range(alphabet)]
    for c in range(alphabet):
        now = queues[c].take()
        rounds = 0
        while len(now):
            larges[c].push(now)
            before = now[now > 0] - 1
            before = before[~small[before]]
            own = symbols[before]
            _deal(queues, own[own != c], before[own != c])
            now, rounds = before[own == c], rounds + 1
        seeds = star[star_edges[c] : star_edges[c + 1]]
        before = seeds[seeds > 0] - 1
        _deal(queues, symbols[before], before)
    down = [DiskQueue() for _ in range(alphabet)]
    out: list[np.ndarray] = []
    for c in range(alphabet - 1, -1, -1):
        now, own_small = down[c].take(), []
        if c == 0:
            now = np.append(now, n - 1)
        while len(now):
            own_small.append(now)
            before = now[now > 0] - 1
            before = before[small[before]]
            own = symbols[before]
            _deal(down, own[own != c], before[own != c])
            now = before[own == c]
        large = larges[c].take()
        back = large[::-1]
        before = back[back > 0] - 1
        before = before[small[before]]
        _deal(down, symbols[before], before)
        if own_small:
            out.append(np.concatenate(own_small)[::-1])
        out.append(large)
    return np.concatenate(out[::-1])


def repeated_windows(texts: list[bytes], owners: np.ndarray, window: int) -> list[np.ndarray]:
    """For each text, which of its windows also lie in a text of a smaller owner."""
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum()) + len(texts), np.uint16)
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols[:] = joined
    symbols += 1
    symbols[starts + sizes] = 0
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    order = sort_suffixes(symbols)
    order = order[order + window <= (starts + sizes)[of[order]]]
    padded = np.concatenate([symbols, np.zeros(DEPTH, symbols.dtype)])
    same = np.ones(max(0, len(order) - 1), bool)
    for word in prefix_words(padded, order, window):
        same &= word[1:] == word[:-1]
    found = np.zeros(len(symbols), bool)
    if len(order):
        groups = np.flatnonzero(np.concatenate(([True], ~same)))
        least = np.minimum.reduceat(owners[of[order]], groups)
        least = np.repeat(least, np.diff(np.append(groups, len(order))))
        found[order] = least < owners[of[order]]
    return [found[a : a + max(0, s - window + 1)] for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)]
