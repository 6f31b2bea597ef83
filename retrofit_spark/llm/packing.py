"""Best-fit packing of token sequences by a linear grouping scheme.

A document is its ids and an end id. One that is longer than a sequence is cut into pieces of the sequence's size, of which
the first may be shorter. What has to be decided depends on lengths alone, and there are no more lengths than a sequence has
tokens, so the packing is planned from the number of pieces of each length, whatever the size of the corpus (plan()):

1. Lengths above a share of a sequence are large. Sorted, they are put into groups of equal cardinality, and each is
   rounded up to its group's largest.
2. For these few sizes, configurations (which sizes share a sequence) are found by column generation: a linear programme
   for the least number of sequences, whose columns are knapsacks. Configurations are used as often as the solution's whole part says.
3. Actual lengths take the places of the rounded ones, largest first. Up to two places of a configuration may be left open.
4. What is left, large ones first and then small ones, goes where it fits best: to the sequence with the least room that holds it.

The share (an eighth to a half) and the number of open places are those that take fewest sequences. Rounding wastes room that
only small pieces can fill; where there are few of these, configurations matter, and where there are many, exact fits do.

Sequences with the same content are one run, so the plan is a table of intervals: pieces number a to b of one length
go to sequences from c on, at an offset. Its size is bounded by the number of lengths. Spark numbers the pieces of each length, without a
group by length: a task counts its own, and tasks' counts are added up. A piece then looks up its interval.

Null text counts as empty: it is packed as its end id alone. Rows that repeat are packed each; null ids are ids. An empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from copy import deepcopy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import text_slices
from .scratch import Scratch, documents
from .units import encoder, tokenizer_path

SIZE, END_ID, TOKENIZER = 2048, 0, "byte_bpe_50k.json"
#: Lengths above one part in so many of a sequence are large, as it takes fewest sequences.
LARGE_PARTS = (8, 4, 3, 2)
#: So many of a configuration's smallest places are left to the last step, which fits actual lengths.
OPEN = (0, 1, 2)
#: Bytes of text that are encoded at once: working arrays are some dozens of times as large.
ENCODED = 1 << 20
#: Groups of large lengths: more waste less room and take longer to solve, on the driver, at any size of corpus.
GROUPS = 128
#: Steps of column generation for each group; each step leaves a plan that is whole, so an end before the optimum costs room only.
STEPS = 12

_PIECES = "doc_id long, piece int, start long, length int, ids array<int>, part int, place long"


def numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each item's number among those of its length, counting on from `seen`, which is brought up to date."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - np.repeat(first, np.diff(np.append(first, len(lengths)))) + seen[ordered]
    np.add.at(seen, lengths, 1)
    return out


def _cut(path: str, end_id: int, size: int):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for rows, data, offsets in text_slices(batches, limit=ENCODED):
            ids, at = encoder(path).encode(data, offsets)
            whole = np.insert(ids, at[1:], end_id)
            ends = at[1:] + np.arange(1, rows.num_rows + 1)
            total = np.diff(np.concatenate(([0], ends)))
            pieces = -(-total // size)
            row = np.repeat(np.arange(rows.num_rows), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = (total - 1) % size + 1  # of the first piece
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * size)
            length = np.where(piece == 0, short[row], size)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(whole.astype(np.int32)))
            columns = [rows.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), lists, pa.array(np.full(len(row), part), pa.int32()), pa.array(numbered(length, seen), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "part", "place"])

    return run


def grouped(counts: np.ndarray, least: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, how many items of each), descending: lengths of `least` and more, in groups of equal cardinality, rounded up to a group's largest."""
    lengths = np.arange(len(counts) - 1, least - 1, -1)
    upto = np.concatenate(([0], np.cumsum(counts[lengths])))
    total = int(upto[-1])
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = -(-total // groups)
    begins = np.arange(0, total, each)
    sizes = lengths[np.searchsorted(upto, begins, "right") - 1]
    many = np.diff(np.append(begins, total))
    new = np.flatnonzero(np.concatenate(([True], sizes[1:] != sizes[:-1])))
    return sizes[new], np.add.reduceat(many, new)


def fullest(sizes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """How many of each size to take for the greatest sum of values within `size`: a knapsack with repeats."""
    best, choice = np.zeros(size + 1), np.full(size + 1, -1)
    for k, (s, v) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
        if v <= 0:
            continue
        for at in range(s, size + 1, s):
            end = min(at + s, size + 1)
            other = best[at - s : end - s] + v
            better = other > best[at:end] + 1e-12
            best[at:end][better] = other[better]
            choice[at:end][better] = k
    out, room = np.zeros(len(sizes), np.int64), int(best.argmax())
    while room > 0 and choice[room] >= 0:
        out[choice[room]] += 1
        room -= int(sizes[choice[room]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(configurations as columns, how often each is used, whole numbers): the whole part of the least-sequences programme's solution."""
    m = len(sizes)
    if not m:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    basis = np.diag(np.maximum(size // sizes, 1)).astype(float)
    wanted = demand + np.linspace(0, 1e-6, m)  # equal demands would make steps of no length
    for _ in range(STEPS * m):
        prices = np.linalg.solve(basis.T, np.ones(m))
        column = fullest(sizes, prices, size)
        if column @ prices <= 1 + 1e-7:
            break
        used, step = np.linalg.solve(basis, wanted), np.linalg.solve(basis, column.astype(float))
        falls = step > 1e-9
        if not falls.any():
            break
        ratio = np.where(falls, np.maximum(used, 0) / np.where(falls, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    columns = np.rint(basis).astype(np.int64)
    often = np.floor(np.linalg.solve(basis, demand.astype(float)) + 1e-7).astype(np.int64).clip(0)
    for k in range(m):  # rounding errors mustn't use more than there is
        inside = columns[:, k] > 0
        often[k] = min([often[k], *((demand - columns @ often + columns[:, k] * often[k])[inside] // columns[inside, k]).tolist()])
    return columns, often


class Packing:
    """Runs of sequences with equal room, and the intervals of pieces that have been put into them.

    An interval (length, first, count, each, base, offset): pieces first, first+1, ... of this length, `each` of them to each of the
    sequences base, base+1, ..., one after the other from `offset` on.
    """

    def __init__(self, counts: np.ndarray, size: int):
        self.size, self.left, self.taken, self.sequences = size, counts.copy(), np.zeros(size + 1, np.int64), 0
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.open = np.zeros(size + 1, bool)
        self.intervals: list[tuple[int, int, int, int, int, int]] = []

    def _put(self, length: int, each: int, base: int, many: int, room: int) -> int:
        """`each` pieces to each of `many` sequences that have `room`; the room that is left."""
        count = each * many
        self.intervals.append((length, int(self.taken[length]), count, each, base, self.size - room))
        self.taken[length] += count
        self.left[length] -= count
        return room - each * length

    def _close(self, room: int, base: int, many: int) -> None:
        if many and room:
            self.room[room].append((base, many))
            self.open[room] = True

    def run(self, lengths: list[int], many: int) -> None:
        """`many` new sequences with one piece of each of these lengths."""
        base, room = self.sequences, self.size
        self.sequences += many
        for length in lengths:
            room = self._put(length, 1, base, many, room)
        self._close(room, base, many)

    def substitute(self, demand: np.ndarray, columns: np.ndarray, often: np.ndarray) -> None:
        """Actual pieces, longest first, in place of each group's size."""
        lengths = np.arange(self.size, -1, -1)
        ends = np.cumsum(self.left[lengths])
        group = np.cumsum(demand) - demand  # places of the groups' next pieces, counted from the longest piece
        runs = []
        for k in np.flatnonzero(often):
            many, begins = int(often[k]), []
            for g in np.flatnonzero(columns[:, k]):
                for _ in range(int(columns[g, k])):
                    begins.append(int(group[g]))
                    group[g] += many
            cuts = {0, many}  # where the length of one of the places changes
            for begin in begins:
                a, b = np.searchsorted(ends, [begin, begin + many - 1], "right")
                cuts |= set((ends[a:b] - begin).tolist())
            cuts = sorted(cuts)
            runs += [(begins, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for begins, a, b in runs:
            self.run(lengths[np.searchsorted(ends, [begin + a for begin in begins], "right")].tolist(), b - a)

    def best_fit(self) -> None:
        """All pieces that are left, longest first, each to the sequence with the least room that holds it."""
        for length in range(self.size, 0, -1):
            while self.left[length]:
                room = length + int(self.open[length:].argmax())
                if not self.open[room]:
                    each = self.size // length
                    many = max(int(self.left[length]) // each, 1)
                    each = min(each, int(self.left[length]))
                    base = self.sequences
                    self.sequences += many
                    self._close(self._put(length, each, base, many, self.size), base, many)
                    continue
                base, many = self.room[room].pop()
                each = room // length
                full = min(many, int(self.left[length]) // each)
                if full:
                    self._close(self._put(length, each, base, full, room), base, full)
                else:  # the last few go into one sequence
                    full = 1
                    self._close(self._put(length, int(self.left[length]), base, 1, room), base, 1)
                if many > full:
                    self.room[room].append((base + full, many - full))
                self.open[room] = bool(self.room[room])


def plan(counts: np.ndarray, size: int = SIZE, groups: int = GROUPS) -> Packing:
    """The packing of counts[n] pieces of each length n, 1 to size: the one with fewest sequences over LARGE_PARTS and OPEN."""
    best = None
    for parts in LARGE_PARTS:
        whole = Packing(counts, size)
        if counts[size]:
            whole.run([size], int(counts[size]))
        sizes, demand = grouped(whole.left, size // parts + 1, groups)
        columns, often = configurations(sizes, demand, size)
        for places in OPEN:
            out, kept = deepcopy(whole), columns.copy()
            for k in range(kept.shape[1]):
                for _ in range(min(places, int(kept[:, k].sum()) - 1)):
                    kept[np.flatnonzero(kept[:, k])[-1], k] -= 1
            out.substitute(demand, kept, often)
            out.best_fit()
            best = out if best is None or out.sequences < best.sequences else best
    return best


def _places(table: np.ndarray):
    """(sequence_id, offset) of a piece by its length and number."""
    begins = (table[:, 0] << 44) + table[:, 1]

    def look_up(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        row = np.searchsorted(begins, (length << 44) + number, "right") - 1
        of_interval = number - table[row, 1]
        return pd.DataFrame({"sequence_id": table[row, 4] + of_interval // table[row, 3], "offset": table[row, 5] + of_interval % table[row, 3] * length})

    return F.pandas_udf(look_up, "sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, size: int = SIZE, groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id and offset. Sequences have at most `size` tokens, no gaps, and any numbers."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.write(documents(docs, id_col, text_col).mapInArrow(_cut(path or tokenizer_path(TOKENIZER), end_id, size), _PIECES), "pieces")
    tally = scratch.write(cut.groupBy("part", "length").count(), "tally")
    counts = np.zeros(size + 1, np.int64)
    for r in tally.groupBy("length").agg(F.sum("count").alias("n")).collect():  # as many rows as there are lengths
        counts[r.length] = r.n
    table = np.array(sorted(plan(counts, size, groups).intervals), np.int64).reshape(-1, 6)
    by_part = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tally.select("part", "length", F.coalesce(F.sum("count").over(by_part), F.lit(0)).alias("before"))
    placed = cut.join(before, ["part", "length"]).withColumn("at", _places(table)(F.col("length"), F.col("place") + F.col("before")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of its pieces, one after the other."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(pieces, lambda p: p["ids"])).alias("ids"))


def _crc32(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()))


def digest(packed: DataFrame) -> DataFrame:
    """The contract's columns from pack()."""
    return packed.select("doc_id", "piece", "start", "length", F.pandas_udf(_crc32, "long")("ids").alias("ids_crc32"), "sequence_id", "offset")
