"""Removal of repeated substrings of documents by suffix sorting.

Every window of 50 bytes is assigned to the least hash of its 24-byte substrings; consecutive windows with
one such minimiser make a stretch. Equal windows have equal minimisers, so a window can only be
repeated within its minimiser's group, which loses nothing and lets most of the corpus out of the sort:

1. Blocks of text, GROUP at a time, send their distinct stretches (minimiser, digest, least doc_id) to the minimiser's range.
2. A range finds stretches that an earlier document has whole, and those that share their minimiser
   with a different stretch of an earlier document.
3. Only the latter are sent as text, once by each block with a row of the least doc_id, and a range sorts their suffixes by external induced
   sorting (induced.py); windows in one run of common prefixes of 50 bytes take the least doc_id of the run.
4. Blocks turn both answers into removed bytes.

A block answers for all its copies of a stretch, so what is sent doesn't grow with the copies in it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import SpanHash, by_range, mix, text_slices
from .induced import repeated_windows
from .scratch import Scratch, documents

WINDOW, GRAM = 50, 24
RANGES, RANGE_BYTES, SORT_BYTES, BLOCK_BYTES = 64, 4 << 20, 1 << 20, 1 << 19
#: Blocks whose stretches travel together: a row for each range is for so many of them.
GROUP = 8
_LOW = np.uint64((1 << 48) - 1)
_SPREAD = np.uint64(0x5851F42D4C957F2D)
_GRAM = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_TAIL_BITS = np.uint64(24)
_TAIL = np.uint64((1 << 24) - 1)

_BLOCKS = "group string, parts array<struct<doc_ids: array<long>, bounds: array<long>, data: binary>>"
BLOCK_SCHEMA = pa.schema([("group", pa.string()), ("parts", pa.list_(pa.struct([("doc_ids", pa.list_(pa.int64())), ("bounds", pa.list_(pa.int64())), ("data", pa.binary())])))])


def _blocks(batches):
    from pyspark import TaskContext

    part, packer = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
    parts, made = [], 0
    for rows, data, offsets in text_slices(batches, limit=BLOCK_BYTES):
        parts.append({"doc_ids": rows.column(0).to_pylist(), "bounds": offsets.tolist(), "data": packer.compress(data.tobytes())})
        if len(parts) == GROUP:
            yield pa.RecordBatch.from_pylist([{"group": f"{part}-{made}", "parts": parts}], schema=BLOCK_SCHEMA)
            parts, made = [], made + 1
    if parts:
        yield pa.RecordBatch.from_pylist([{"group": f"{part}-{made}", "parts": parts}], schema=BLOCK_SCHEMA)


class Block:
    """The stretches of a block: lo and hi (first and last window), row, entry; and its entries, distinct by (minimiser, digest), sorted."""

    def __init__(self, doc_ids: list, bounds: list, packed: bytes):
        self.bounds = np.array(bounds, np.int64)
        self.data = np.frombuffer(zstandard.decompress(packed) if self.bounds[-1] else b"", np.uint8)
        self.null = np.array([x is None for x in doc_ids], bool)
        self.ids = np.array([x or 0 for x in doc_ids], np.int64)
        lo, hi, row, minimisers = stretches(self.data, self.bounds)
        named = ~self.null[row]
        self.lo, self.hi, self.row = lo[named], hi[named], row[named]
        digests = SpanHash(self.data).of(self.lo, self.hi + WINDOW) & _LOW
        minimisers, ids = minimisers[named], self.ids[self.row]
        # By the minimiser's first bits and then a hash: one fast sort. Should a stretch come apart here, ranges put it together.
        order = np.argsort(minimisers & ~_TAIL | mix(minimisers * _SPREAD + digests) & _TAIL)
        m, d = minimisers[order], digests[order]
        starts = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (d[1:] != d[:-1])))) if len(order) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        self.entry = np.zeros(len(order), np.int64)
        self.entry[order] = group
        self.least = np.minimum.reduceat(ids[order], starts) if len(starts) else ids
        own = np.flatnonzero(ids[order] == self.least[group]) if len(starts) else starts
        self.first = order[own[np.searchsorted(group[own], np.arange(len(starts)))]]
        self.m, self.d = m[starts], d[starts]

    def edges(self, ranges: int) -> list[int]:
        return [*np.searchsorted(self.m >> _TAIL_BITS, np.array([((k << 64) // ranges) >> int(_TAIL_BITS) for k in range(ranges)], np.uint64)).tolist(), len(self.m)]


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, row, minimiser) of each stretch."""
    n, none = len(data) - WINDOW + 1, np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    eights = np.ascontiguousarray(SpanHash(data).eights[: len(data) - 7])
    grams = eights[:-16] * _GRAM[0]  # of GRAM = 3 * 8 bytes
    grams += eights[8:-8] * _GRAM[1]
    grams += eights[16:] * _GRAM[2]
    grams ^= grams >> np.uint64(29)
    grams *= _SPREAD
    least, span, reach = grams, 1, WINDOW - GRAM + 1
    while span * 2 <= reach:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])[:n]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    valid = np.arange(n) + WINDOW <= bounds[row + 1]
    starts = valid.copy()
    starts[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    stops = valid.copy()
    stops[:-1] &= ~valid[1:] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    lo, hi = np.flatnonzero(starts), np.flatnonzero(stops)
    return lo, hi, row[lo], mix(least[lo])  # minima are small numbers: mixed, ranges of them are alike in size


def _narrow(x: np.ndarray) -> tuple[int, bytes, int]:
    """Integers as the least, and the distances from it in as few bytes as they need."""
    base = int(x.min()) if len(x) else 0
    away = (x - base).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if not len(away) or int(away.max()) < 1 << (8 * w))
    return base, away.astype(f"<u{width}").tobytes(), width


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_SENT = "range int, group string, m binary, d binary, base long, width int, away binary"
_SENT_SCHEMA = pa.schema([("range", pa.int32()), ("group", pa.string()), ("m", pa.binary()), ("d", pa.binary()), ("base", pa.int64()), ("width", pa.int32()), ("away", pa.binary())])


def _by_range(ranges: int, found: list[tuple]):
    """(range, the arrays of all blocks' entries in it, one block after the other) of (edges, arrays) of each block."""
    for k in range(ranges):
        own = [(arrays, edges[k], edges[k + 1]) for edges, arrays in found if edges[k] < edges[k + 1]]
        if own:
            yield k, *(np.concatenate(x) for x in zip(*(tuple(array[a:z] for array in arrays) for arrays, a, z in own), strict=True))


def _send(ranges: int):
    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                found, rows = [], []
                for part in x["parts"]:
                    b = Block(part["doc_ids"], part["bounds"], part["data"])
                    found.append((b.edges(ranges), (b.m, b.d, b.least)))
                for k, m, d, least in _by_range(ranges, found):
                    base, away, width = _narrow(least)
                    rows.append({"range": k, "group": x["group"], "m": _six(m & _LOW), "d": _six(d), "base": base, "width": width, "away": away})
                if rows:
                    yield from pa.Table.from_pylist(rows, _SENT_SCHEMA).to_batches()

    return run


class Answers:
    """What the ranges say about a group's entries, handed out block by block."""

    def __init__(self, ranges: int, verdicts: list, bits: list | None = None):
        self.ranges = ranges
        self.verdicts = {r["range"]: np.frombuffer(r["verdict"], np.uint8) for r in verdicts or []}
        self.bits = {r["range"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in bits or []}
        self.at, self.bit = dict.fromkeys(self.verdicts, 0), dict.fromkeys(self.bits, 0)

    def verdict(self, edges: list[int]) -> np.ndarray:
        """For each of the next block's entries."""
        out = np.zeros(edges[-1], np.uint8)
        for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < z:
                at = self.at[k]
                out[a:z] = self.verdicts[k][at : at + z - a]
                self.at[k] = at + z - a
        return out

    def windows(self, edges: list[int], verdict: np.ndarray, sizes: np.ndarray) -> dict[int, np.ndarray]:
        """For each of the next block's entries whose text was asked for: which of its windows are repeated."""
        out: dict[int, np.ndarray] = {}
        for k in self.bits:
            own = edges[k] + np.flatnonzero(verdict[edges[k] : edges[k + 1]] & 2)
            ends = self.bit[k] + np.cumsum(sizes[own])
            out |= {e: self.bits[k][z - n : z] for e, n, z in zip(own.tolist(), sizes[own].tolist(), ends.tolist(), strict=True)}
            if len(own):
                self.bit[k] = int(ends[-1])
        return out


def _judge(batches):
    """For each group's entries in order: bit 0, an earlier document has the stretch whole; bit 1, its text is asked for."""
    for k, rows in by_range(batches):
        m, d = _from_six(b"".join(r["m"] for r in rows)), _from_six(b"".join(r["d"] for r in rows))
        ids = np.concatenate([np.frombuffer(r["away"], f"<u{r['width']}").astype(np.uint64).astype(np.int64) + r["base"] for r in rows])
        sizes = np.array([len(r["m"]) // 6 for r in rows])
        order = np.argsort(mix(m * _SPREAD + mix(d)))
        sm, sd, sid = m[order], d[order], ids[order]
        new = np.concatenate(([True], (sm[1:] != sm[:-1]) | (sd[1:] != sd[:-1])))
        hashed = mix(sm[new] * _SPREAD + mix(sd[new]))
        if (hashed[1:] == hashed[:-1]).any():  # two stretches with one hash could lie among each other
            order = np.lexsort((d, m))
            sm, sd, sid = m[order], d[order], ids[order]
            new = np.concatenate(([True], (sm[1:] != sm[:-1]) | (sd[1:] != sd[:-1])))
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(sid, starts)  # of each stretch
        by_m = np.argsort(sm[starts])
        m_new = np.concatenate(([True], sm[starts][by_m][1:] != sm[starts][by_m][:-1]))
        m_starts, m_of = np.flatnonzero(m_new), np.cumsum(m_new) - 1
        low, high = np.minimum.reduceat(least[by_m], m_starts), np.maximum.reduceat(least[by_m], m_starts)
        asked = np.zeros(len(starts), bool)
        asked[by_m] = (low < high)[m_of]  # some stretch of the minimiser comes from a later document
        verdict = np.zeros(len(m), np.uint8)
        whole = sid > least[group]
        own = sid == least[group]  # in all blocks that hold rows of the least doc_id
        verdict[order] = whole | ((own & asked[group]).astype(np.uint8) << 1)
        at = 0
        for r, n in zip(rows, sizes.tolist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([r["group"]]), pa.array([k], pa.int32()), pa.array([verdict[at : at + n].tobytes()], pa.binary())], ["group", "range", "verdict"])
            at += n


_ASKED = pa.schema([("range", pa.int32()), ("group", pa.string()), ("m", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary())])


def _texts(ranges: int):
    """Texts asked for: range, group, their minimisers, owners, sizes and bytes."""

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                answers = Answers(ranges, x["verdicts"])
                if not any((v & 2).any() for v in answers.verdicts.values()):
                    continue
                found: dict[int, list] = {}
                for part in x["parts"]:
                    b = Block(part["doc_ids"], part["bounds"], part["data"])
                    edges, raw = b.edges(ranges), b.data.tobytes()
                    own = np.flatnonzero(answers.verdict(edges) & 2)
                    first = b.first[own]
                    a, z = b.lo[first], b.hi[first] + WINDOW
                    cuts = np.searchsorted(own, edges)
                    for k in np.flatnonzero(np.diff(cuts)).tolist():
                        i, j = int(cuts[k]), int(cuts[k + 1])
                        text = b"".join(raw[p:q] for p, q in zip(a[i:j].tolist(), z[i:j].tolist(), strict=True))
                        found.setdefault(k, []).append((b.m[own[i:j]].tobytes(), b.least[own[i:j]].tobytes(), (z - a)[i:j].astype(np.int64).tobytes(), text))
                rows = [{"range": k, "group": x["group"], **dict(zip(("m", "ids", "sizes", "text"), map(b"".join, zip(*v, strict=True)), strict=True))} for k, v in found.items()]
                yield from pa.Table.from_pylist(rows, _ASKED).to_batches()

    return run


def _sort(batches):
    """Bits of repeated windows, for each group's texts in order. Minimisers are sorted together up to SORT_BYTES of text; one of more is sorted by itself."""
    for k, rows in by_range(batches):
        m = np.concatenate([np.frombuffer(r["m"], np.uint64) for r in rows])
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in rows])
        joined = b"".join(r["text"] for r in rows)
        at = np.cumsum(sizes) - sizes
        order = np.argsort(m, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], m[order][1:] != m[order][:-1])))
        volume, cuts, last = np.cumsum(sizes[order]), [0], 0
        for g in new[1:].tolist():
            if volume[g - 1] - last > SORT_BYTES:
                cuts.append(g)
                last = volume[g - 1]
        bits: list = [None] * len(m)
        for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[a:z]
            for i, found in zip(own.tolist(), repeated_windows([joined[at[i] : at[i] + sizes[i]] for i in own.tolist()], ids[own], WINDOW), strict=True):
                bits[i] = found
        first = 0
        for r in rows:
            n = len(r["m"]) // 8
            yield pa.RecordBatch.from_arrays([pa.array([r["group"]]), pa.array([k], pa.int32()), pa.array([np.packbits(np.concatenate(bits[first : first + n])).tobytes()], pa.binary())], ["group", "range", "bits"])
            first += n


def _remove(ranges: int, with_text: bool):
    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                answers = Answers(ranges, x["verdicts"], x["answers"])
                for part in x["parts"]:
                    yield _removed(Block(part["doc_ids"], part["bounds"], part["data"]), part["doc_ids"], answers, with_text)

    return run


def _removed(b: Block, doc_ids: list, answers: Answers, with_text: bool) -> pa.RecordBatch:
    change = np.zeros(len(b.data) + 1, np.int64)
    edges = b.edges(answers.ranges)
    verdict = answers.verdict(edges)
    if len(b.entry):
        whole = (verdict[b.entry] & 1 > 0) | (b.ids[b.row] > b.least[b.entry])
        np.add.at(change, b.lo[whole], 1)
        np.add.at(change, b.hi[whole] + WINDOW, -1)
        part = np.flatnonzero(~whole & (verdict[b.entry] & 2 > 0))
        of_entry = answers.windows(edges, verdict, (b.hi - b.lo + 1)[b.first])
        for i in part.tolist():
            at = b.lo[i] + np.flatnonzero(of_entry[int(b.entry[i])])
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
    gone = np.cumsum(change[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = b.bounds[:-1][b.bounds[:-1] < len(gone)]
    begins[inner] = gone[inner]
    total, runs = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(begins)))
    kept = [b.data[a:z][~gone[a:z]].tobytes() for a, z in zip(b.bounds[:-1].tolist(), b.bounds[1:].tolist(), strict=True)]
    columns = [pa.array(doc_ids, pa.int64()), pa.array(np.diff(b.bounds)), pa.array(np.diff(total[b.bounds])), pa.array(np.diff(runs[b.bounds])), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
    return pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if with_text else []), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, on request).

    A byte is removed where a 50-byte string over it also starts in a document of a smaller doc_id. Null text
    counts as empty. Rows of one doc_id don't remove each other's bytes; a row without doc_id neither
    loses nor removes any. An empty table gives none.
    """
    scratch, own = Scratch(docs.sparkSession), documents(docs, id_col, text_col)
    blocks = scratch.write(own.mapInArrow(_blocks, _BLOCKS), "blocks")
    size = blocks.agg(F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.element_at(p["bounds"], -1)))).head()[0] or 0
    ranges = max(RANGES, -(-size // RANGE_BYTES))
    judged = scratch.write(blocks.mapInArrow(_send(ranges), _SENT).repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_judge, "group string, range int, verdict binary"), "judged")
    whole = judged.groupBy("group").agg(F.collect_list(F.struct("range", "verdict")).alias("verdicts"))
    asked = blocks.hint("merge").join(whole.hint("merge"), "group").mapInArrow(_texts(ranges), "range int, group string, m binary, ids binary, sizes binary, text binary")
    answered = scratch.write(asked.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_sort, "group string, range int, bits binary"), "answered")
    answers = answered.groupBy("group").agg(F.collect_list(F.struct("range", "bits")).alias("answers"))
    ready = blocks.hint("merge").join(whole.hint("merge"), "group", "left").join(answers.hint("merge"), "group", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return ready.mapInArrow(_remove(ranges, with_text), schema)
