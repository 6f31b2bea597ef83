"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (all words of a shorter text). A shingle weighs its count in the text
times a factor of 0.9 to 1 that falls with the share of documents that have it. The factor is
bounded so that large groups of near copies, whose common shingles are frequent by being copied,
keep their similarity. Document frequencies come from a sketch of fixed size over all documents: as
long as texts hold some hundred shingles, what falls together in a cell stays below the share at
which the factor begins to fall, at any number of documents.

Thirty bands of five samples make documents candidates; a pair of similarity 0.8 shares a band with
probability 0.99999. Texts with the same shingles are one node. Every two nodes that share a bucket are
compared unless they are known to be of one component by then, without a row for each pair:

1. Each node meets the pivot with which it shares most buckets; a bucket's pivot is the node that meets most others.
2. In a bucket that still holds several components, the one with most nodes anywhere is the host and the others are guests. All
   nodes of a guest meet all of its host, once for all buckets that the two share.
3. Guests of a bucket meet each other.

Who meets is dealt into cells of bounded size: two blocks of shingle vectors, of which one is looked up in an inverted
index of the other. Hosts and buckets of any size are so many cells. A cell compares by the weighted Jaccard
similarity of whole vectors and gives a link only where it joins two components. Links join components, not
nodes, so they get fewer from step to step. Classes are the connected components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import LOWER, SpanHash, mix, spread, text_slices, words
from .components import components
from .scratch import Scratch, documents

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5
CELLS, SHARE, SPAN = 1 << 20, 1e-3, 0.1
BLOCK = 1 << 14
#: Shingles of a block of vectors that meets others in one cell; a longer vector is a block of its own.
MEETING = 1 << 17

_rng = np.random.default_rng(424242)
_TABLE = 1 << 16
_R, _LOG_C = _rng.gamma(2, 1, _TABLE).astype(np.float32), np.log(_rng.gamma(2, 1, _TABLE)).astype(np.float32)
_BETA = _rng.random(_TABLE).astype(np.float32)
_ODD = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Floats as unsigned integers of the same order, in the upper half of 64 bits."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)


_UNIT = _ordered(_LOG_C + _R * _BETA - _R)  # ln a for weight 1, where t is 0


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count), distinct, by row and hash."""
    data = LOWER[data]
    starts, ends, rows = words(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    hashes = SpanHash(data).of(starts, ends)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(WORDS):  # short texts end before the fifth word
        here = np.zeros(len(hashes), np.uint64)
        here[: max(len(hashes) - k, 0)] = hashes[k:]
        if k:
            here[np.arange(len(hashes)) + k >= (first + n)[rows]] = 0
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + here
    place = np.arange(len(hashes)) - first[rows]
    whole = (place + WORDS <= n[rows]) | ((place == 0) & (n[rows] < WORDS))
    hashes, rows = mix(rolled[whole]), rows[whole]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]))))
    return rows[new], hashes[new], np.diff(np.append(new, len(hashes)))


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(12)).astype(np.uint32) & np.uint32(CELLS - 1)


def _sketch(batches):
    cells, docs = np.zeros(CELLS, np.int64), 0
    for rows, data, offsets in text_slices(batches):
        cells += np.bincount(_cell(shingles(data, offsets)[1]), minlength=CELLS)
        docs += rows.num_rows
    yield from _cell_blocks(cells, docs)


def _cell_blocks(cells: np.ndarray, docs: int):
    if docs:
        for k in range(0, CELLS, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([docs], pa.int64()), pa.array([cells[k : k + BLOCK].astype(np.uint32).tobytes()], pa.binary())], ["block", "docs", "cells"])


def _summed(batches) -> dict[int, list]:
    total: dict[int, list] = {}
    for batch in batches:
        for k, docs, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = total.setdefault(k, [0, 0])
            own[0] += docs
            own[1] = own[1] + np.frombuffer(cells, np.uint32).astype(np.int64)
    return total


def _sum_cells(batches):
    for k, (docs, cells) in _summed(batches).items():
        factor = 1 - SPAN + SPAN * np.clip(np.log(np.maximum(cells, 1) / docs) / np.log(SHARE), 0, 1)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([factor.astype(np.float32).tobytes()], pa.binary())], ["block", "factors"])


def shingle_factors(docs: DataFrame) -> np.ndarray:
    """The idf factor of each cell; CELLS floats whatever the size of the corpus."""
    sums = docs.select("text").mapInArrow(_sketch, "block int, docs long, cells binary").repartition("block").mapInArrow(_sum_cells, "block int, factors binary")
    factors = np.ones(CELLS, np.float32)
    for r in sums.collect():
        factors[r.block : r.block + BLOCK] = np.frombuffer(r.factors, np.float32)
    return factors


def samples(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, k: int, starts: np.ndarray) -> np.ndarray:
    """The k-th consistent weighted sample of each row: 32 bits that stand for (shingle, t)."""
    at = (hashes * _ODD[k] >> np.uint64(48)).astype(np.int64)
    key = _UNIT[at] | (hashes & np.uint64(0xFFFFFFFF))
    odd = np.flatnonzero(weights != 1)
    if len(odd):
        r, beta = _R[at[odd]], _BETA[at[odd]]
        t = np.floor(np.log(weights[odd]) / r + beta)
        rank = _ordered(_LOG_C[at[odd]] - r * (t - beta) - r)
        key[odd] = rank | np.where(t == 0, hashes[odd], mix(hashes[odd] + t.astype(np.int64).astype(np.uint64))) & np.uint64(0xFFFFFFFF)
    return np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)


def _signatures(shared):
    """doc_id, key, node (a digest of the shingles with their counts; of the text where it has no words), number of shingles, bands."""

    def run(batches):
        factors = shared.value
        for part, data, offsets in text_slices(batches):
            rows, hashes, counts = shingles(data, offsets)
            weights = counts * factors[_cell(hashes)]
            some, starts = np.unique(rows, return_index=True)
            bands = np.zeros((len(some), BANDS), np.uint64)
            if len(some):
                for k in range(BANDS * ROWS):
                    b = k // ROWS
                    bands[:, b] = mix(bands[:, b] * np.uint64(31) + samples(rows, hashes, weights, k, starts) + np.uint64(b + 1))
            packed = np.stack([hashes, counts.astype(np.uint64)], axis=1)
            raw, ends = data.tobytes(), np.append(starts, len(rows))[1:]
            nodes = [hashlib.blake2b(raw[offsets[i] : offsets[i + 1]], digest_size=16, person=b"text").digest() for i in range(part.num_rows)] if len(some) < part.num_rows else [b""] * part.num_rows
            lists = [None] * part.num_rows
            for i, a, b, own in zip(some.tolist(), starts.tolist(), ends.tolist(), bands.view(np.int64), strict=True):
                nodes[i], lists[i] = hashlib.blake2b(packed[a:b].tobytes(), digest_size=16, person=b"shingles").digest(), own
            volume = np.bincount(rows, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(nodes, pa.binary()), pa.array(volume, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "key", "node", "volume", "bands"])

    return run


def _pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Hashes, counts in as few bytes as the largest needs, and that width."""
    width = next(w for w in (1, 2, 4) if not len(counts) or int(counts.max()) < 1 << (8 * w))
    return hashes.tobytes() + counts.astype(f"<u{width}").tobytes() + bytes([width])


def _unpack(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = vector[-1]
    n = (len(vector) - 1) // (8 + width)
    return np.frombuffer(vector, np.uint64, n), np.frombuffer(vector, f"<u{width}", n, 8 * n)


def _vectors(batches):
    """node, its shingles' hashes and counts."""
    for part, data, offsets in text_slices(batches):
        rows, hashes, counts = shingles(data, offsets)
        bounds = np.searchsorted(rows, np.arange(part.num_rows + 1)).tolist()
        out = [_pack(hashes[a:b], counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["node", "vector"])


HOST, GUEST, BOTH = 0, 1, 2


def cell_links(labels: list[bytes], sides: np.ndarray, vectors: list[bytes], factors: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Pairs of labels that near-duplicate nodes of one cell join, none that follows from the others.

    Hosts meet guests; nodes that are both meet each other. Similarity is the sum of least over the sum of
    largest weights.
    """
    names, component = np.unique(np.array(labels, object), return_inverse=True)
    if len(names) < 2:
        return []
    parts = [_unpack(v) for v in vectors]
    sizes = np.array([len(h) for h, _ in parts])
    ends = np.cumsum(sizes)
    hashes = np.concatenate([h for h, _ in parts])
    weights = factors[_cell(hashes)].astype(np.float64) * np.concatenate([c for _, c in parts])
    whole = np.add.reduceat(weights, ends - sizes)
    hosts, guests = np.flatnonzero(sides != GUEST), np.flatnonzero(sides != HOST)
    asking, listed = (hosts, guests) if len(hosts) < len(guests) else (guests, hosts)
    of = np.repeat(np.arange(len(parts)), sizes)
    inside = np.zeros(len(parts), bool)
    inside[listed] = True
    at = np.flatnonzero(inside[of])
    at = at[np.argsort(hashes[at], kind="stable")]
    index, owner, weight = hashes[at], of[at], weights[at]
    links = []
    for x in asking.tolist():
        if (component[listed] == component[x]).all():
            continue
        own, mine = hashes[ends[x] - sizes[x] : ends[x]], weights[ends[x] - sizes[x] : ends[x]]
        first = np.searchsorted(index, own, "left")
        n = np.searchsorted(index, own, "right") - first
        met = spread(first, n)
        common = np.bincount(owner[met], np.minimum(weight[met], np.repeat(mine, n)), len(parts))
        alike = np.flatnonzero(common >= (THRESHOLD - 1e-6) * (whole + whole[x] - common))
        for y in alike[np.unique(component[alike], return_index=True)[1]].tolist():
            if component[y] != component[x]:
                links.append((labels[x], labels[y]))
                component[component == component[y]] = component[x]
    return links


def _meet(shared):
    """Links of all cells of a partition that is sorted by cell."""

    def run(batches):
        factors = shared.value
        for batch, edges in _unbroken(batches, "cell"):
            side, label, vector = (batch.column(batch.schema.get_field_index(k)) for k in ("side", "label", "vector"))
            found = []
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                found += cell_links(label[a:z].to_pylist(), side[a:z].to_numpy(), vector[a:z].to_pylist(), factors)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

    return run


def _unbroken(batches, key: str):
    """(batch, edges of its runs of one key) of batches that don't divide a run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield _one(held)
            held = []
        if last:
            yield _one([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    keys = batch.column(batch.schema.get_field_index("cell")).to_numpy()
    return batch, np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def _dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of each key in blocks: own; number of blocks of each key). `members` has key, node, label, volume."""
    blocks = members.groupBy("key").agg(F.ceil(F.sum("volume") / MEETING).alias("blocks"))
    return members.join(blocks.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks"), blocks


def star_cells(hosts: DataFrame, guests: DataFrame) -> DataFrame:
    """cell, side, node, label: each block of a key's hosts with each block of its guests."""
    (left, left_blocks), (right, right_blocks) = _dealt(hosts), _dealt(guests)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    cell = lambda i, j: F.xxhash64("key", i, j).alias("cell")  # noqa: E731  two keys in one cell would only meet more
    left = left.join(right_blocks.hint("merge"), "key").select("key", "own", "node", "label", other).select(cell("own", "other"), F.lit(HOST).alias("side"), "node", "label")
    right = right.join(left_blocks.hint("merge"), "key").select("key", "own", "node", "label", other).select(cell("other", "own"), F.lit(GUEST).alias("side"), "node", "label")
    return left.unionByName(right)


def group_cells(members: DataFrame) -> DataFrame:
    """cell, side, node, label: each block of a key's members with itself and with each other."""
    dealt, blocks = _dealt(members)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    both = dealt.join(blocks.hint("merge"), "key").select("key", "own", "node", "label", other)
    side = F.when(F.col("own") == F.col("other"), BOTH).when(F.col("own") < F.col("other"), HOST).otherwise(GUEST).alias("side")
    return both.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), side, "node", "label")


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, key (xxhash64 of the text), class_id, class_key (doc_id and key of the class's first row), class_size."""
    spark = docs.sparkSession
    scratch, own = Scratch(spark), documents(docs, id_col, text_col)
    own = own.withColumn("key", F.xxhash64("text"))  # rows that share a doc_id, or have none, are told apart by it
    shared = spark.sparkContext.broadcast(shingle_factors(own))
    signed = scratch.write(own.mapInArrow(_signatures(shared), "doc_id long, key long, node binary, volume long, bands array<long>"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("at")
    nodes = signed.groupBy("node").agg(first, F.count(F.lit(1)).alias("rows"), F.first("volume").alias("volume"), F.first("bands").alias("bands"))
    nodes = scratch.write(nodes.select("node", F.col("at.doc_id").alias("doc_id"), F.col("at.key").alias("key"), "rows", "volume", "bands"), "nodes")
    bands = nodes.where("bands IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    degrees = bands.join(sizes.hint("merge"), "bucket").groupBy("node").agg(F.sum(F.col("size") - 1).alias("degree")).where("degree > 0")
    # The nodes that meet any other, their components' labels, and their vectors.
    state = scratch.write(nodes.join(degrees.hint("merge"), "node").withColumn("label", F.col("node")).withColumn("was", F.col("node")), "state")
    at = state.select("node", F.col("doc_id").alias("at_id"), F.col("key").alias("at_key"))
    texts = own.hint("merge").join(at.hint("merge"), own["doc_id"].eqNullSafe(at["at_id"]) & (own["key"] == at["at_key"])).select("node", "text")
    vectors = scratch.write(texts.mapInArrow(_vectors, "node binary, vector binary").dropDuplicates(["node"]), "vectors")

    def joined(state: DataFrame, cells: DataFrame, name: str) -> DataFrame:
        """The state after the links that the cells give."""
        met = cells.join(vectors.hint("merge"), "node").select("cell", "side", "label", "vector")
        links = scratch.write(met.repartition("cell").sortWithinPartitions("cell").mapInArrow(_meet(shared), "a binary, b binary").distinct(), f"links-{name}")
        if links.isEmpty():
            return state.withColumn("was", F.col("label"))
        map_ = components(links, scratch, f"labels-{name}").select(F.col("node").alias("old"), F.col("label").alias("new"))
        after = state.join(map_.hint("merge"), state["label"] == map_["old"], "left").withColumn("was", F.col("label")).withColumn("label", F.coalesce("new", "label"))
        return scratch.write(after.drop("old", "new"), f"state-{name}")

    rows = state.select("node", "degree", "volume", F.explode("bands").alias("bucket"))
    pivots = rows.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("top"))
    pivot = F.col("top.node")
    shares = rows.join(pivots.hint("merge"), "bucket").groupBy("node", pivot.alias("pivot")).agg(F.count(F.lit(1)).alias("shared"), F.first("volume").alias("volume"), F.max(pivot != F.col("node")).alias("other"))
    best = shares.where("other").groupBy("node").agg(F.max(F.struct("shared", "pivot")).alias("best"), F.first("volume").alias("volume"))
    guests = scratch.write(best.select(F.col("best.pivot").alias("key"), "node", F.col("node").alias("label"), "volume"), "guests")
    hosts = guests.select("key").distinct().select("key", F.col("key").alias("node"), F.col("key").alias("label"), F.lit(1).cast("long").alias("volume"))
    state = joined(state, star_cells(hosts, guests), "pivots")

    def by_bucket() -> DataFrame:
        return state.select("node", "label", "was", "volume", F.explode("bands").alias("bucket"))

    # The host is the component with most nodes of all, so that a guest meets few hosts though it shares many buckets.
    weight = state.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))
    present = by_bucket().groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).join(weight.hint("merge"), "label")
    several = present.groupBy("bucket").agg(F.max(F.struct("nodes", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("bucket", F.col("top.label").alias("host"))
    several = scratch.write(several, "several")
    edges = scratch.write(present.join(several.hint("merge"), "bucket").where("label != host").select(F.col("host").alias("key"), F.col("label").alias("guest")).distinct(), "edges")
    members = state.select("node", "label", "volume")
    hosts = members.join(edges.select("key").distinct().hint("merge"), members["label"] == F.col("key")).select("key", "node", "label", "volume")
    guests = members.join(edges.hint("merge"), members["label"] == edges["guest"]).select("key", "node", "label", "volume")
    state = joined(state, star_cells(hosts, guests), "hosts")

    rest = by_bucket().join(several.hint("merge"), "bucket").where("was != host").select("bucket", "node", "label", "volume")
    # Buckets whose guests are the same nodes are one group.
    open_ = rest.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.bit_xor(F.xxhash64("node")).alias("nodes"), F.count(F.lit(1)).alias("n"))
    open_ = scratch.write(open_.where("least < most").groupBy("nodes", "n").agg(F.min("bucket").alias("bucket")).select("bucket"), "open")
    state = joined(state, group_cells(rest.join(open_.hint("merge"), "bucket").select(F.col("bucket").alias("key"), "node", "label", "volume")), "guests")

    labelled = nodes.select("node", "doc_id", "key", "rows").join(state.select("node", "label").hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = labelled.groupBy("label").agg(first, F.sum("rows").alias("class_size"))
    of_node = labelled.join(classes.hint("merge"), "label").select("node", F.col("at.doc_id").alias("class_id"), F.col("at.key").alias("class_key"), "class_size")
    return signed.select("doc_id", "key", "node").join(of_node.hint("merge"), "node").select("doc_id", "key", "class_id", "class_key", "class_size")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size.

    Null text counts as empty. Texts without words are alike only where they are equal. Repeated rows are rows
    of their own in one class. Null doc_ids don't name a class unless it has no other. An empty table gives none.
    """
    return near_rows(docs, id_col, text_col).select("doc_id", "class_id", "class_size")
