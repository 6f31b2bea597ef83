"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Every word has a fixed sparse index vector that its hash gives. A word's vector is the sum of the index
vectors of its neighbours over all documents (random indexing), labelled or not, kept for hash buckets of words,
so its size is a parameter; so are the frequencies that weigh words. Labels aren't used for either. The same is learnt for word shapes (which kinds of
characters follow each other), which unseen words share. A document's features are its words' and
shapes' vectors, weighted against frequent ones and averaged, and a few plain measures. The network's logits
are divided by a temperature fitted on rows that it wasn't trained on, so that scores are probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import SpanHash, mix, text_slices, words
from .scratch import bounded, documents

DIMENSIONS, BUCKETS, NONZERO, REACH, HIDDEN = 32, 1 << 14, 4, 2, 32
#: The classifier is fitted on so many labelled rows at most, those below a threshold of a hash of their doc_id.
SAMPLE_ROWS = 20_000
#: Text worked on at once; words take some twenty times their bytes.
SLICE = 1 << 20
BLOCK = 512

_SPACE = np.ones(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = False
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = ord("0")
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = _SHAPE[128:] = ord("a")


class Tokens:
    """Word and shape buckets of a slice, and the documents' plain measures."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.rows = words(data, offsets, _SPACE)
        self.docs = len(offsets) - 1
        hashes = SpanHash(data).of(starts, ends)
        shape = _SHAPE[data]
        kept = np.ones(len(data), bool)
        kept[1:] = shape[1:] != shape[:-1]
        kept[starts] = True
        place = np.concatenate(([0], np.cumsum(kept)))
        shapes = SpanHash(shape[kept]).of(place[starts], place[ends])
        self.units = [(hashes % np.uint64(BUCKETS)).astype(np.int64), (shapes % np.uint64(BUCKETS)).astype(np.int64)]
        n = np.bincount(self.rows, minlength=self.docs)
        size = np.maximum(np.diff(offsets), 1)
        ratio = lambda hits, of: np.add.reduceat(np.append(hits, 0).astype(float), np.minimum(offsets[:-1], len(hits)))[: self.docs] / of * (np.diff(offsets) > 0)
        again = np.zeros(len(starts), bool)
        if len(starts) > 1:
            again[1:] = (hashes[1:] == hashes[:-1]) & (self.rows[1:] == self.rows[:-1])
        pairs = np.unique(np.stack([self.rows.astype(np.uint64), hashes]), axis=1) if len(starts) < 2 else None
        if pairs is None:
            order = np.lexsort((hashes, self.rows))
            r, h = self.rows[order], hashes[order]
            new = np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])))
            unique = np.bincount(r[new], minlength=self.docs)
        else:
            unique = n
        some = np.maximum(n, 1)
        self.plain = np.stack(
            [
                np.log1p(n) / 8,
                np.bincount(self.rows, weights=ends - starts, minlength=self.docs) / some / 10,
                ratio((data >= 65) & (data < 91), size),
                ratio((data >= 48) & (data < 58), size),
                ratio((data > 32) & (data < 127) & ~np.isin(_SHAPE[data], [48, 65, 97]), size),
                ratio(data == 10, size) * 10,
                np.bincount(self.rows, weights=again, minlength=self.docs) / some,
                unique / some,
            ],
            axis=1,
        )


def index_vectors(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, signs) of each bucket's index vector, NONZERO each."""
    hashed = mix(buckets[:, None].astype(np.uint64) * np.uint64(NONZERO) + np.arange(1, NONZERO + 1, dtype=np.uint64))
    return (hashed % np.uint64(DIMENSIONS)).astype(np.int64), np.where(hashed >> np.uint64(63), 1.0, -1.0)


def _contexts(batches):
    """Sums of neighbours' index vectors and counts, for blocks of buckets of words, then of shapes."""
    sums = [np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS * DIMENSIONS)]
    counts = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    dimensions, signs = index_vectors(np.arange(BUCKETS))
    for _, data, offsets in text_slices(batches, limit=SLICE):
        t = Tokens(data, offsets)
        for k, own in enumerate(t.units):
            counts[k] += np.bincount(own, minlength=BUCKETS)
            for reach in range(1, REACH + 1):
                near = np.flatnonzero(t.rows[reach:] == t.rows[:-reach])
                for word, other in ((own[near], own[near + reach]), (own[near + reach], own[near])):
                    for z in range(NONZERO):
                        sums[k] += np.bincount(word * DIMENSIONS + dimensions[other, z], weights=signs[other, z], minlength=BUCKETS * DIMENSIONS)
    for k in range(2):
        table = np.concatenate([sums[k].reshape(BUCKETS, DIMENSIONS), counts[k][:, None]], axis=1)
        for a in range(0, BUCKETS, BLOCK):
            part = table[a : a + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k * BUCKETS + a], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["block", "sums"])


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[k] = total.get(k, 0.0) + np.frombuffer(part, np.float32).astype(np.float64)
    for k, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["block", "sums"])


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Unit vectors from summed contexts, weighted down for frequent words; words without contexts keep their index vector."""
    counts = table[:, :, -1]
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    vectors = table[:, :, :-1]
    dimensions, signs = index_vectors(np.arange(BUCKETS))
    own = np.zeros((BUCKETS, DIMENSIONS))
    np.add.at(own, (np.arange(BUCKETS)[:, None], dimensions), signs)
    norms = np.linalg.norm(vectors, axis=2, keepdims=True)
    vectors = np.where(norms > 0, vectors / np.maximum(norms, 1e-9), 0) + 0.5 * own / np.sqrt(NONZERO)
    return (vectors * (1e-3 / (1e-3 + share))[:, :, None]).astype(np.float32)


def pooled(t: Tokens, vectors: np.ndarray) -> np.ndarray:
    """Features of a slice's documents."""
    n = np.maximum(np.bincount(t.rows, minlength=t.docs), 1)[:, None]
    out = []
    for k, own in enumerate(t.units):
        sums = np.zeros((t.docs, DIMENSIONS))
        some = np.unique(t.rows)
        if len(some):
            sums[some] = np.add.reduceat(vectors[k][own].astype(np.float64), np.searchsorted(t.rows, some), axis=0)
        out.append(sums / n)
    return np.concatenate([*out, t.plain], axis=1)


class Network:
    """Two layers, trained by Adam on the bounded sample; then the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 40):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = self._scaled(x)
        order = rng.permutation(len(x))
        calibration, train = order[: len(x) // 5], order[len(x) // 5 :]
        self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step, self.temperature = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0, 1.0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
                step += 1
                for a, g, k in zip(self.p, self._gradient(x[at], y[at]), range(4), strict=True):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    a -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if len(calibration):
            logits, own = self._logits(x[calibration]), y[calibration]
            loss = lambda t: np.logaddexp(0, np.where(own > 0, -logits, logits) / t).mean()
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _hidden(self, x):
        return np.tanh(x @ self.p[0] + self.p[1])

    def _logits(self, x):
        return self._hidden(x) @ self.p[2] + self.p[3][0]

    def _gradient(self, x, y):
        h = self._hidden(x)
        d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3][0]))) - y) / len(x)
        back = np.outer(d, self.p[2]) * (1 - h * h)
        return x.T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(self._scaled(x)) / self.temperature, -60, 60)))


class QualityModel:
    """Vectors and network, or a constant where there is nothing to learn from; of a size that the parameters fix."""

    def __init__(self, vectors: np.ndarray | None, network: Network | None, constant: float = 0.5):
        self.vectors, self.network, self.constant = vectors, network, constant

    def slice_scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, self.constant)
        return self.network.score(pooled(Tokens(data, offsets), self.vectors))


def fold(id_col: str, folds: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_fold: int = 1, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Vectors of all documents' words; a network of labelled rows outside the held-out fold, `sample_rows` of them at most. Null labels, and labels without a document, don't count."""
    spark = docs.sparkSession
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where((fold("doc_id", folds) != held_fold) & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, sample_rows / max(1, known.count()))
    if share < 1:  # by a threshold of the hash, so that no task sends more than its part
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(950_000 * share)).limit(sample_rows)
    rows = known.collect()  # sample_rows at most
    if len({r.label for r in rows}) < 2:
        return QualityModel(None, None, float(rows[0].label) if rows else 0.5)
    picked = spark.createDataFrame([(r.doc_id, r.label) for r in rows], "doc_id long, label int")
    sample = documents(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").repartition(8, "doc_id").persist()
    table = np.zeros((2 * BUCKETS, DIMENSIONS + 1))
    contexts = documents(docs, id_col, text_col).select("text").mapInArrow(_contexts, "block int, sums binary").repartition("block").mapInArrow(_add, "block int, sums binary")
    with bounded(spark):
        sums = contexts.collect()  # the vectors' size
    for r in sums:
        table[r.block : r.block + BLOCK] = np.frombuffer(r.sums, np.float32).reshape(-1, DIMENSIONS + 1)
    vectors = word_vectors(table.reshape(2, BUCKETS, DIMENSIONS + 1))
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches):
        for part, data, offsets in text_slices(batches, limit=SLICE):
            x = pooled(Tokens(data, offsets), shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "label", "x"])

    with bounded(spark):
        found = sorted(sample.select("doc_id", "text", "label").mapInArrow(features, "doc_id long, label int, x binary").collect())  # sample_rows small vectors
    sample.unpersist()
    if len({r.label for r in found}) < 2:
        return QualityModel(None, None, float(found[0].label) if found else 0.5)
    return QualityModel(vectors, Network(np.stack([np.frombuffer(r.x) for r in found]), np.array([r.label for r in found], float)))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every document: the probability of label 1. Null text counts as empty; repeated rows are scored each; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value.slice_scores(data, offsets))], ["doc_id", "score"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, folds=folds, held_fold=held_fold)
    return score(docs, model).select("doc_id", (fold("doc_id", folds) == held_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with all their columns whose score is at least a half."""
    model = fit(docs, labels, id_col, text_col)
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches):
        for rows, data, offsets in text_slices(batches, text_col, SLICE):
            yield rows.filter(pa.array(shared.value.slice_scores(data, offsets) >= 0.5))

    return docs.mapInArrow(run, schema)
