"""Hard-negative mining by an inverted multi-index.

Vectors of whole numbers are cut into two halves, each half has a codebook, and a pair of codewords is a cell. Codebooks are
fitted (k-means) on a sample of at most about SAMPLE rows; every row is indexed. Rows are sorted by cell and cut into shards of
bounded size; a shard knows for each of its codewords how far the farthest half of its rows is away. A query's inner product with a
half is at most that with the codeword plus the query half's length times this radius, and a row's score is at most
the sum of its two halves' bounds. A search walks through a shard's cells from the greatest sum down: the halves' bounds are sorted,
and a heap gives the next best pair of the two sequences. It ends when all its windows are certified: a
window of scores, low to high, is certified when it is full and its last score is above the bound of the next cell, or when that bound is
below the window. Cells that are wholly above the open windows are passed over. So the result is exact, whatever the codebooks.

Queries are cut into blocks, and each block meets each shard: a stated set of queries against all rows. Positives come from a
search of the anchor's label with one open window, whose low end is known from the sample to begin with; negatives from a search of
the other labels with a window for each positive. Best rows of all shards are merged by rank.

Of rows with the same label and vector, only the KEEP with the least ids can be among the first of any search, so
the others aren't indexed; a vector that a third of all rows share is six rows. Rows with a null label, a null vector or null components take no part. A null id
is the last among ties, and its row is no anchor. Rows that repeat are rows of their own. Vectors of unequal length are filled up with
zeros. Products of two vectors' lengths beyond 2^62 raise an error. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SAMPLE, CODEWORDS, ROUNDS = 8192, 16, 12
SHARD, BLOCK = 1 << 14, 1 << 10
POSITIVES, NEGATIVES = 5, 5
#: One more than positives, since an anchor finds itself.
KEEP = POSITIVES + 1
#: A negative's score is at least 80 / 100 of the positive's.
LOW, HIGH = 80, 100
#: Rows that are scored at once.
STEP = 1024
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _codes(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest codeword of each row."""
    return ((book**2).sum(1) - 2 * (half @ book.T)).argmin(1)


def codebook(half: np.ndarray, words: int = CODEWORDS) -> np.ndarray:
    """k-means of the sample's halves."""
    rng = np.random.default_rng(7)
    book = half[rng.permutation(len(half))[:words]].astype(float)
    for _ in range(ROUNDS):
        code = _codes(half, book)
        n = np.bincount(code, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, code, half)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Arrays of whole numbers as rows of one length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def narrow(x: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers in as few bytes as the largest needs, and that width."""
    most = int(np.abs(x).max()) if x.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return x.astype(f"<i{width}").tobytes(), width


def wide(raw: bytes, width: int, dims: int) -> np.ndarray:
    x = np.frombuffer(raw, f"<i{width}")
    return x.reshape(-1, dims) if dims else x.reshape(0, 0)


_SHARD = "shard string, n int, vectors binary, width int, ids binary, nulls binary, labels binary, cells binary"


def _assign(dims: int, books):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2), dims)
                cells = _codes(x[:, : dims // 2], books[0]) * len(books[1]) + _codes(x[:, dims // 2 :], books[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["id", "label", "vector", "cell"])

    return run


def _shards(dims: int):
    def run(batches):
        from pyspark import TaskContext

        part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def shard(rows: pa.Table):
            ids = rows.column("id")
            raw, width = narrow(matrix(rows.column("vector"), dims))
            return pa.RecordBatch.from_pylist([{
                "shard": f"{part}-{made}", "n": rows.num_rows, "vectors": raw, "width": width, "ids": ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                "nulls": ids.is_null().to_numpy().astype(np.uint8).tobytes(), "labels": rows.column("label").to_numpy().astype("<i8").tobytes(), "cells": rows.column("cell").to_numpy().astype("<i4").tobytes(),
            }], schema=SHARD_SCHEMA)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= SHARD:
                rows = pa.Table.from_batches(held)
                yield shard(rows.slice(0, SHARD))
                made += 1
                held, n = rows.slice(SHARD).to_batches(), n - SHARD
        if n:
            yield shard(pa.Table.from_batches(held))

    return run


SHARD_SCHEMA = pa.schema([("shard", pa.string()), ("n", pa.int32()), ("vectors", pa.binary()), ("width", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("labels", pa.binary()), ("cells", pa.binary())])


class Shard:
    """Rows sorted by cell and label, with the radii of their codewords."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, nulls: np.ndarray, labels: np.ndarray, cells: np.ndarray, books):
        self.ids, self.nulls, self.labels, self.books = ids, nulls, labels, books
        self.dims, second = vectors.shape[1], len(books[1])
        x = vectors.astype(np.float64)
        self.reach = float(np.sqrt((x**2).sum(1)).max(initial=0))
        self.vectors = {np.float64: x, np.int64: vectors.astype(np.int64)}
        self.half, self.codes, self.radii = self.dims // 2, [], []
        for k, (code, part) in enumerate(((cells // second, x[:, : self.half]), (cells % second, x[:, self.half :]))):
            own = np.unique(code)
            radius = np.zeros(len(books[k]))
            np.maximum.at(radius, code, np.sqrt(((part - books[k][code]) ** 2).sum(1)))
            self.codes.append(own)
            self.radii.append(radius[own])
        edges = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
        self.where = {(int(c) // second, int(c) % second): (int(a), int(b)) for c, a, b in zip(cells[edges], edges, np.append(edges[1:], len(cells)), strict=True)}

    def kind(self, length: float):
        """The type in which scores are exact: sums of products are at most the product of the lengths."""
        most = length * self.reach
        if most >= 1 << 62:
            raise ValueError("scores don't fit into 64 bits")
        return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64

    def rows(self, kind) -> np.ndarray:
        if kind not in self.vectors:
            self.vectors[kind] = self.vectors[np.float64].astype(kind)
        return self.vectors[kind]

    def cells(self, query: np.ndarray):
        """(greatest score, least score, first row, end) of each cell, by the greatest score down."""
        order, up, down = [], [], []
        for k, part in enumerate((query[: self.half], query[self.half :])):
            middle = self.books[k][self.codes[k]] @ part
            away = np.sqrt((part**2).sum()) * self.radii[k]
            slack = 1e-6 + 1e-9 * (np.abs(middle) + away)
            by = np.argsort(-(middle + away), kind="stable")
            order.append(self.codes[k][by].tolist())
            up.append((middle + away + slack)[by].tolist())
            down.append((middle - away - slack)[by].tolist())
        (first, second), (up1, up2), (down1, down2) = order, up, down
        heap = [(-(up1[0] + up2[0]), 0, 0)] if first and second else []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(second):
                heapq.heappush(heap, (-(up1[i] + up2[j + 1]), i, j + 1))
            if not j and i + 1 < len(first):
                heapq.heappush(heap, (-(up1[i + 1] + up2[0]), i + 1, 0))
            found = self.where.get((first[i], second[j]))
            if found:
                yield -bound, down1[i] + down2[j], *found

    def search(self, query: np.ndarray, label: int, same: bool, windows: list[tuple[int, int]], want: int):
        """(for each window the first `want` rows as (score, row), how many rows were scored): rows of the same label, or of others, by score down, then id."""
        real = query.astype(np.float64)
        kind = self.kind(float(np.sqrt((real**2).sum())))
        vectors, own = self.rows(kind), query.astype(kind)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        floor = [low for low, _ in windows]  # the least score that is still of use
        scored, waiting, n = 0, [], 0

        def score():
            rows = np.concatenate([np.arange(a, b) for a, b in waiting])
            rows = rows[(self.labels[rows] == label) == same]
            scores = (vectors[rows] @ own).astype(np.int64)
            for w, (_, high) in enumerate(windows):
                fits = np.flatnonzero((scores >= floor[w]) & (scores <= high))
                if len(fits):
                    s, r = np.concatenate((best[w][0], scores[fits])), np.concatenate((best[w][1], rows[fits]))
                    first = np.lexsort((self.ids[r], self.nulls[r], -s))[:want]
                    best[w] = s[first], r[first]
                    if len(first) == want:
                        floor[w] = max(floor[w], int(s[first[-1]]))
            return len(rows)

        for bound, least, a, b in self.cells(real):
            if all(bound < low for low in floor):
                break
            if all(least > high for _, high in windows):
                continue
            waiting.append((a, b))
            n += b - a
            if n >= STEP:
                scored += score()
                waiting, n = [], 0
        if waiting:
            scored += score()
        return best, scored


_BLOCK = pa.schema([("shard", pa.string()), ("anchors", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32()), ("sizes", pa.binary()), ("lows", pa.binary()), ("highs", pa.binary())])
_BLOCK_SQL = "shard string, anchors binary, labels binary, vectors binary, width int, sizes binary, lows binary, highs binary"


def _blocks(dims: int, sample: tuple[np.ndarray, np.ndarray] | None = None):
    """Anchors (anchor, label, vector, highs) as blocks. With a sample: one open window, from the last of the KEEP best scores that the sample shows."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x, labels = matrix(batch.column(2), dims), batch.column(1).to_numpy().astype(np.int64)
                if sample is None:
                    highs = batch.column(3)
                    sizes, high = np.diff(highs.offsets.to_numpy()), highs.flatten().to_numpy()
                    low = -(-LOW * high // HIGH)
                else:
                    vectors, of = sample
                    sizes, high, low = np.ones(len(x), np.int64), np.full(len(x), _MOST), np.full(len(x), _LEAST)
                    small = np.sqrt((x.astype(float) ** 2).sum(1)).max(initial=0) * np.sqrt((vectors.astype(float) ** 2).sum(1)).max(initial=0) < 1 << 53
                    if small:  # scores are exact
                        scores = x.astype(float) @ vectors.T.astype(float)
                        for k, label in enumerate(labels):
                            mine = scores[k, of == label]
                            if len(mine) >= KEEP:
                                low[k] = int(np.partition(mine, len(mine) - KEEP)[len(mine) - KEEP])
                raw, width = narrow(x)
                yield pa.RecordBatch.from_pylist([{
                    "shard": None, "anchors": batch.column(0).to_numpy().astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "vectors": raw, "width": width,
                    "sizes": sizes.astype("<i4").tobytes(), "lows": low.astype("<i8").tobytes(), "highs": high.astype("<i8").tobytes(),
                }], schema=_BLOCK)

    return run


def _meet(dims: int, books, same: bool, want: int):
    """Rows of a block joined with a shard: (anchor, window, score, id) of each anchor's first rows there."""

    def run(batches):
        name, shard = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != name:
                    name = r["shard"]
                    shard = Shard(wide(r["vectors"], r["width"], dims) if dims else np.zeros((r["n"], 0), np.int64), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["nulls"], np.uint8), np.frombuffer(r["labels"], "<i8"), np.frombuffer(r["cells"], "<i4"), books)
                anchors, labels = np.frombuffer(r["anchors"], "<i8"), np.frombuffer(r["own_labels"], "<i8")
                queries = wide(r["own_vectors"], r["own_width"], dims) if dims else np.zeros((len(anchors), 0), np.int64)
                ends = np.cumsum(np.frombuffer(r["sizes"], "<i4"))
                lows, highs = np.frombuffer(r["lows"], "<i8").tolist(), np.frombuffer(r["highs"], "<i8").tolist()
                out = [[], [], [], []]
                for k, end in enumerate(ends.tolist()):
                    begin = int(ends[k - 1]) if k else 0
                    found, _ = shard.search(queries[k], int(labels[k]), same, list(zip(lows[begin:end], highs[begin:end], strict=True)), want)
                    for w, (scores, rows) in enumerate(found):
                        out[0].append(np.full(len(rows), anchors[k]))
                        out[1].append(np.full(len(rows), w))
                        out[2].append(scores)
                        out[3].append(rows)
                anchor, window, score, row = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(window.astype(np.int32)), pa.array(score), pa.array(shard.ids[row], mask=shard.nulls[row].astype(bool))], ["anchor", "window", "score", "id"])

    return run


def _searched(shards: DataFrame, blocks: DataFrame, dims: int, books, same: bool, want: int) -> DataFrame:
    """The first rows of each anchor and window, among all shards: anchor, window, score, id, rank."""
    slots = max(1, shards.count())
    names = blocks.drop("shard").withColumnsRenamed({c: f"own_{c}" for c in ("labels", "vectors", "width")})
    # A block is dealt to every slot, and meets there the shards that their names put into it, all rows of a shard in turn.
    dealt = names.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    placed = shards.withColumn("slot", F.pmod(F.xxhash64("shard"), F.lit(slots)).cast("int"))
    met = placed.join(dealt.hint("merge"), "slot").drop("slot").mapInArrow(_meet(dims, books, same, want), "anchor long, window int, score long, id long")
    first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= want)


def mine(rows: DataFrame, id_col: str = "id", label_col: str = "label", vector_col: str = "vector", anchor_col: str = "anchor") -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id long, label, vector array<long>, anchor boolean. A score is the inner product with the anchor. An anchor's positives are the
    first POSITIVES other rows of its label, by score down, then id; a positive's negatives are the first
    NEGATIVES rows of other labels whose score is between LOW / HIGH of the positive's and the positive's.
    """
    scratch = Scratch(rows.sparkSession)
    vector = rows[vector_col].cast("array<long>")
    own = rows.select(rows[id_col].cast("long").alias("id"), rows[label_col].cast("long").alias("label"), vector.alias("vector"), F.coalesce(rows[anchor_col], F.lit(False)).alias("is_anchor"))
    own = scratch.write(own.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", F.isnull)), "rows")
    n, dims, asked = own.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.count_if(F.col("is_anchor") & F.col("id").isNotNull())).first()
    place = Window.partitionBy("label", "vector").orderBy(F.asc_nulls_last("id"))
    kept = own.select("id", "label", "vector", F.row_number().over(place).alias("place")).where(F.col("place") <= KEEP).drop("place")
    kept = scratch.write(kept, "kept")
    # The sample is picked by a hash of whole rows, about SAMPLE of them at any size.
    share = F.pmod(F.xxhash64("label", "vector", "id"), F.lit(1 << 40)) < F.lit(min(1 << 40, (SAMPLE << 40) // max(n, 1)))
    sample = kept.where(share).select("label", "vector").toArrow()
    vectors, labels = matrix(sample.column("vector"), dims), sample.column("label").to_numpy().astype(np.int64)
    half = dims // 2
    books = tuple(codebook(x) if len(x) else np.zeros((1, x.shape[1])) for x in (vectors[:, :half].astype(float), vectors[:, half:].astype(float)))
    celled = kept.mapInArrow(_assign(dims, books), "id long, label long, vector array<long>, cell int")
    shards = scratch.write(celled.repartitionByRange("cell", F.xxhash64("vector", "id")).sortWithinPartitions("cell", "label", "id").mapInArrow(_shards(dims), _SHARD), "shards")
    anchors = own.where(F.col("is_anchor") & F.col("id").isNotNull()).select("id", "label", "vector").repartition(max(1, -(-asked // BLOCK)))
    anchors = scratch.write(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    length = F.aggregate("vector", F.lit(0).cast("long"), lambda total, x: total + x * x)
    blocks = scratch.write(anchors.select("anchor", "label", "vector").mapInArrow(_blocks(dims, (vectors, labels)), _BLOCK_SQL), "blocks")
    near = scratch.write(_searched(shards, blocks, dims, books, True, KEEP), "near")
    # An anchor is among its own first rows, if at all, with its id and its squared length as score; rows that equal it in both are alike.
    met = near.join(anchors.select("anchor", F.col("id").alias("anchor_id"), length.alias("own")), "anchor")
    itself = F.col("id").eqNullSafe(F.col("anchor_id")) & (F.col("score") == F.col("own"))
    by_anchor = Window.partitionBy("anchor").orderBy("rank")
    skipped = met.withColumn("twin", F.sum(itself.cast("int")).over(by_anchor)).where(~(itself & (F.col("twin") == 1)))
    positives = skipped.withColumn("window", (F.row_number().over(by_anchor) - 1).cast("int")).where(F.col("window") < POSITIVES)
    positives = scratch.write(positives.select("anchor", "window", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "positive_score"))), lambda x: x["positive_score"]).alias("highs"))
    asking = anchors.select("anchor", "label", "vector").join(windows, "anchor").repartition(max(1, -(-asked // BLOCK)))
    blocks = scratch.write(asking.mapInArrow(_blocks(dims), _BLOCK_SQL), "asking")
    found = scratch.write(_searched(shards, blocks, dims, books, False, NEGATIVES), "negatives")
    return positives.join(found, ["anchor", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def of_embeddings(embeddings: DataFrame) -> DataFrame:
    """The table `embeddings` as mine() takes it: components in 256ths, every seventh row's label moved on, every hundredth row an anchor."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label: Column = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True))).select(
        F.col("vec_id").cast("long").alias("id"), label.alias("label"), whole.alias("vector"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor")
    )
