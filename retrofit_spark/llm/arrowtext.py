"""Arrow text columns as numpy bytes, in slices of bounded size, with vectorised hashing and tokenising.

Every Python-side operator of this package works through these helpers: a slice holds a few MB of
text however large the Arrow batch is, so working memory doesn't depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

#: Spans of more bytes are hashed one by one.
LONG_SPAN = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 of eight bytes.
_FULL = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, UTF-8 bytes, offsets) for runs of rows of about `limit` bytes; null texts are empty. A text longer than that is a slice of its own."""
    for batch in batches:
        values = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()), b"")
        if not len(values):
            continue
        _, at, data = values.buffers()
        ends = np.frombuffer(at, np.int64)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(values):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any byte spans of one slice. Eight bytes after eight go through a mixing permutation, so there is no sum
    or polynomial whose terms could cancel, whatever pattern the bytes have; spans of more than LONG_SPAN bytes are digests (BLAKE2b)."""

    def __init__(self, data: np.ndarray):
        self.data, padded = data, np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = ends - starts
        out, long = mix(lengths.astype(np.uint64)), np.flatnonzero(lengths > LONG_SPAN)
        at = np.flatnonzero((lengths > 0) & (lengths <= LONG_SPAN))
        place, left, state = starts[at], lengths[at], out[at]
        while len(at):
            last = left <= 8
            eight = self.eights[place]
            eight[last] &= _FULL[left[last]]
            state = mix((state ^ eight) + _STEP)
            if last.any():
                out[at[last]] = state[last]
                more = ~last
                at, place, left, state = at[more], place[more], left[more], state[more]
            place, left = place + 8, left - 8
        if len(long):
            raw = memoryview(np.ascontiguousarray(self.data))
            out[long] = np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64)
        return out


def rows_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that holds each position."""
    return np.searchsorted(offsets, positions, "right") - 1


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each run in turn: the gather index of many runs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def is_word_byte() -> np.ndarray:
    """Digits, lower-case letters and every non-ASCII byte."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


WORD = is_word_byte()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the maximal runs of bytes in `table`, broken at row ends. Give lower-cased bytes."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = table[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, rows_of(offsets, starts)


def by_range(batches, key: str = "range"):
    """(key, its rows as dicts), one key at a time; the partition must be sorted by the key."""
    now, rows = None, []
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            row = {name: column[k].as_py() for name, column in zip(names, batch.columns, strict=True)}
            if rows and row[key] != now:
                yield now, rows
                rows = []
                pa.default_memory_pool().release_unused()
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows
