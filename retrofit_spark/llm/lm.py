"""Language-model scoring with a hashed maximum-entropy model.

The model predicts a token's class from its history, then its part of the class, and then the token:
P(w | h) = P(class(w) | h) P(part(w) | class(w), h) P(w | class(w), part(w)). Classes are bands of corpus
frequency, parts are bits of the word's hash. Both softmaxes have a bias and hashed features of the history, in
the second one together with the class: the word before, the two words before (n-grams), and the
word before the last (skip). They are trained by gradient updates that tasks make over their own share
of the training tokens; all training tokens are used in each pass, and the tasks' weights are averaged after it. The
last factor, among words of one band and part, has the bias feature alone, whose maximum-likelihood
weights are relative frequencies. A tenth of the base model is mixed in, so that no token gets less than a tenth
of its base score.

Work is done on slices: a MB of text as indexes into the slice's own sorted vocabulary of
64-bit word hashes. A slice sends its distinct words with their counts to their hash's range and gets back
their corpus counts in the same order, so a word of a third of all tokens is one
entry of each slice. Ranges are as many as their memory needs; a slice sends no more rows than it has
distinct words. Word hashes stand for words throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import LOWER, SpanHash, by_range, mix, text_slices, words
from .scratch import Scratch, documents

CLASSES, PARTS, BUCKETS, FEATURES, BATCH, PASSES, RATE, BASE_SHARE = 16, 16, 1 << 13, 3, 4096, 2, 0.5, 0.1
#: Text of a slice, and slices whose words a range sums at once.
SLICE_BYTES, SLICES_A_RANGE = 1 << 20, 64
END = np.uint64(0x5DEECE66D5DEECE7)
_SPACE = np.ones(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = False

_SLICES = "slice string, part int, doc_ids array<long>, held array<boolean>, bounds array<long>, tokens binary, vocabulary binary"
SLICE_SCHEMA = pa.schema([("slice", pa.string()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("bounds", pa.list_(pa.int64())), ("tokens", pa.binary()), ("vocabulary", pa.binary())])


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def _global(x: dict) -> np.ndarray:
    """Corpus counts of a slice's vocabulary, from its ranges in order."""
    return np.concatenate([_unpack(part["counts"], np.int64) for part in x["lists"]])


def _tokenise(batches):
    """Slices of tokens: indexes into the slice's vocabulary, an end after each document."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for n, (rows, data, offsets) in enumerate(text_slices(batches, limit=SLICE_BYTES)):
        data = LOWER[data]
        starts, ends, of = words(data, offsets, _SPACE)
        hashes = SpanHash(data).of(starts, ends)
        docs = len(offsets) - 1
        bounds = np.searchsorted(of, np.arange(docs + 1))
        hashes = np.insert(hashes, bounds[1:], END)
        bounds = bounds + np.arange(docs + 1)
        vocabulary, tokens = np.unique(hashes, return_inverse=True)
        held = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
        yield pa.RecordBatch.from_pylist(
            [{"slice": f"{part}-{n}", "part": part, "doc_ids": rows.column(0).to_pylist(), "held": held.tolist(), "bounds": bounds.tolist(), "tokens": _pack(tokens.astype(np.uint32)), "vocabulary": vocabulary.tobytes()}],
            schema=SLICE_SCHEMA,
        )


def _training(x: dict) -> np.ndarray:
    """Whether each token of a slice is learned from."""
    return np.repeat(~np.array(x["held"], bool), np.diff(x["bounds"]))


def _send(ranges: int):
    """A row for each slice and hash range that it has words of."""
    first = np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                vocabulary = np.frombuffer(x["vocabulary"], np.uint64)
                counts = np.bincount(_unpack(x["tokens"], np.uint32)[_training(x)], minlength=len(vocabulary)).astype(np.uint32)
                edges = [*np.searchsorted(vocabulary, first).tolist(), len(vocabulary)]
                rows = [(k, x["slice"], vocabulary[a:b].tobytes(), _pack(counts[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["range", "slice", "vocabulary", "counts"])

    return run


def _sum_ranges(batches):
    """Corpus counts, back to each slice in the order of its words; and of each range once, its counts by leaf. One range is held at a time."""
    for k, rows in by_range(batches):
        words_, at = np.unique(np.concatenate([np.frombuffer(r["vocabulary"], np.uint64) for r in rows]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([_unpack(r["counts"], np.uint32) for r in rows]), minlength=len(words_)).astype(np.int64)
        ends = np.cumsum([len(r["vocabulary"]) // 8 for r in rows]).tolist()
        back = [_pack(counts[at[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        known = counts > 0
        leaves = leaves_of(words_[known], counts[known])
        tokens, types = np.bincount(leaves, weights=counts[known], minlength=CLASSES * PARTS), np.bincount(leaves, minlength=CLASSES * PARTS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*(r["slice"] for r in rows), None], pa.string()), pa.array(np.full(len(rows) + 1, k), pa.int32()), pa.array([*back, None], pa.binary()),
                pa.array([None] * len(rows) + [tokens.astype(np.int64)], pa.list_(pa.int64())), pa.array([None] * len(rows) + [types.astype(np.int64)], pa.list_(pa.int64())),
            ],
            ["slice", "range", "counts", "tokens", "types"],
        )


def classes_of(counts: np.ndarray) -> np.ndarray:
    """0 for words seen once or never; else by the power of four that the count reaches."""
    band = 1 + np.floor(np.log2(np.maximum(counts, 2)) / 2).astype(np.int64)
    return np.where(counts <= 1, 0, np.minimum(band, CLASSES - 1))


def leaves_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class and part of each word, as one number."""
    return classes_of(counts) * PARTS + (hashes >> np.uint64(7)).astype(np.int64) % PARTS


def histories(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes of each token's history features."""
    before = np.zeros(len(tokens), np.uint64)
    skip = np.zeros(len(tokens), np.uint64)
    before[1:], skip[2:] = tokens[:-1], tokens[:-2]
    first = bounds[:-1][np.diff(bounds) > 0]
    before[first] = 1
    skip[first] = 2
    second = first[(first + 1 < len(tokens))] + 1
    skip[second] = 2
    return np.stack([mix(before), mix(before * np.uint64(31) + mix(skip)), mix(skip + np.uint64(77))])


def buckets_of(hashed: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """Rows of a weight matrix for history features, together with the class if it is given."""
    if classes is not None:
        hashed = (hashed ^ (classes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)
    return (hashed % np.uint64(BUCKETS)).astype(np.int64) + (np.arange(FEATURES) * BUCKETS)[:, None]


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the features' weights; within 80 of zero, so that no exponential leaves single precision."""
    logits = weights.take(rows[0], 0)
    for more in rows[1:]:
        logits += weights.take(more, 0)
    logits += bias
    return np.clip(logits, -80, 80, out=logits)


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = _logits(weights, bias, rows)
    logits -= np.log(np.exp(logits) @ np.ones(logits.shape[1], logits.dtype))[:, None]
    return logits


def update(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> None:
    """A gradient step over one batch, in place: each feature moves by the mean gradient of its tokens, less where it has few."""
    gradient = _logits(weights, bias, rows)
    np.exp(gradient, out=gradient)
    gradient /= (gradient @ np.ones(gradient.shape[1], gradient.dtype))[:, None]
    gradient[np.arange(len(chosen)), chosen] -= 1
    for k, own in enumerate(rows):
        order = np.argsort((own - k * BUCKETS).astype(np.uint16), kind="stable")
        where = own[order]
        starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        sums = np.add.reduceat(gradient.take(order, 0), starts, axis=0)
        n = np.diff(np.append(starts, len(where)))
        sums *= (RATE / (n + 4.0)).astype(np.float32)[:, None]
        weights[where[starts]] -= sums


def _opened(x: dict):
    """(index of each token in the vocabulary, corpus counts, leaves, history hashes, bounds) of a slice."""
    counts = _global(x)
    index, vocabulary = _unpack(x["tokens"], np.uint32), np.frombuffer(x["vocabulary"], np.uint64)
    bounds = np.array(x["bounds"])
    return index, counts, leaves_of(vocabulary, counts), histories(vocabulary[index], bounds), bounds


def _train(model):
    """Each task starts from the shared weights, updates them over its slices, and gives its change, in blocks of rows."""

    def run(batches):
        weights, class_bias, part_bias = model.value
        own, seen = weights.copy(), 0
        for batch in batches:
            for x in batch.to_pylist():
                index, _, leaves, hashed, _ = _opened(x)
                use = np.flatnonzero(_training(x))
                for a in range(0, len(use), BATCH):
                    at = use[a : a + BATCH]
                    classes, parts = np.divmod(leaves[index[at]], PARTS)
                    update(own[0], class_bias, buckets_of(hashed[:, at]), classes)
                    update(own[1], part_bias.take(classes, 0), buckets_of(hashed[:, at], classes), parts)
                seen += len(use)
        if seen:
            change = (own - weights).reshape(-1, CLASSES)
            for k in range(0, len(change), 512):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seen], pa.int64()), pa.array([_pack(change[k : k + 512].astype(np.float16))], pa.binary())], ["block", "seen", "change"])

    return run


def _mean(batches):
    """Changes of a block of weights, weighted by the tokens behind them."""
    sums: dict[int, list] = {}
    for batch in batches:
        for k, seen, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sums.setdefault(k, [0, 0.0])
            own[0] += seen
            own[1] = own[1] + _unpack(change, np.float16).astype(np.float64) * seen
    for k, (seen, change) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(change / seen).astype(np.float32).tobytes()], pa.binary())], ["block", "change"])


def _score(model):
    def run(batches):
        weights, class_bias, part_bias, tokens_in, types_in, total, distinct = model.value
        for batch in batches:
            for x in batch.to_pylist():
                index, counts, leaves, hashed, bounds = _opened(x)
                base = np.log10((counts + 1) / (total + distinct + 1))
                # A leaf's words share it by their counts; seldom words, and the unseen one, evenly.
                inside = np.log(np.where(counts <= 1, 1 / (types_in[leaves] + 1), np.maximum(counts, 1) / np.maximum(tokens_in[leaves], 1)))
                own = np.empty(len(index))
                for a in range(0, len(index), BATCH):
                    b = slice(a, a + BATCH)
                    classes, parts = np.divmod(leaves[index[b]], PARTS)
                    here = np.arange(len(classes))
                    own[b] = log_softmax(weights[0], class_bias, buckets_of(hashed[:, b]))[here, classes]
                    own[b] += log_softmax(weights[1], part_bias.take(classes, 0), buckets_of(hashed[:, b], classes))[here, parts]
                own = np.log10((1 - BASE_SHARE) * np.exp(own + inside[index]) + BASE_SHARE * 10 ** base[index])
                add = lambda v: np.add.reduceat(v, bounds[:-1])  # noqa: E731  every document has its end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["doc_ids"], pa.int64()), pa.array(x["held"], pa.bool_()), pa.array(np.diff(bounds), pa.int64()), pa.array(add((counts > 0)[index].astype(np.int64)), pa.int64()), pa.array(np.full(len(bounds) - 1, total), pa.int64()), pa.array(add(base[index]), pa.float64()), pa.array(add(own), pa.float64())],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A document is held out where crc32(doc_id as text) mod `folds` is `held_fold`. Null text counts as empty
    and has its end token alone; a null doc_id counts as empty text for the fold; repeated rows are documents of their own, in training too;
    an empty table gives none; with nothing to learn from, every token is unknown.
    """
    spark = docs.sparkSession
    scratch, sc = Scratch(spark), spark.sparkContext
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    own = documents(docs, id_col, text_col).select("doc_id", "text", (fold == held_fold).alias("held"))
    slices = scratch.write(own.mapInArrow(_tokenise, _SLICES), "slices")
    n_slices = slices.count()
    if not n_slices:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    ranges = max(16, n_slices // SLICES_A_RANGE)
    sent = slices.select("slice", "held", "bounds", "tokens", "vocabulary").mapInArrow(_send(ranges), "range int, slice string, vocabulary binary, counts binary")
    back = sent.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_sum_ranges, "slice string, range int, counts binary, tokens array<long>, types array<long>")
    back = scratch.write(back, "counts")
    tokens_in, types_in = np.zeros(CLASSES * PARTS), np.zeros(CLASSES * PARTS)
    leaves = back.where("slice IS NULL").select(F.posexplode(F.arrays_zip("tokens", "types")).alias("leaf", "n")).groupBy("leaf").agg(F.sum("n.tokens").alias("tokens"), F.sum("n.types").alias("types"))
    for r in leaves.collect():  # a row for each leaf
        tokens_in[r.leaf], types_in[r.leaf] = r.tokens, r.types
    total, distinct = int(tokens_in.sum()), int(types_in.sum())

    lists = back.where("slice IS NOT NULL").groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("range", "counts"))).alias("lists"))
    ready = slices.join(lists.hint("merge"), "slice")

    prior = tokens_in.reshape(CLASSES, PARTS) + 1.0
    class_bias, part_bias = np.log(prior.sum(1) / prior.sum()).astype(np.float32), np.log(prior / prior.sum(1, keepdims=True)).astype(np.float32)
    weights = np.zeros((2, FEATURES * BUCKETS, CLASSES), np.float32)
    for step in range(passes):
        model = sc.broadcast((weights, class_bias, part_bias))
        changes = ready.select("held", "bounds", "tokens", "vocabulary", "lists").mapInArrow(_train(model), "block int, seen long, change binary")
        changes = scratch.write(changes.repartition("block").mapInArrow(_mean, "block int, change binary"), f"changes{step}")
        flat = weights.reshape(-1, CLASSES).copy()
        for r in changes.collect():  # the model's size
            flat[r.block : r.block + 512] += np.frombuffer(r.change, np.float32).reshape(-1, CLASSES)
        weights = flat.reshape(weights.shape)
    model = sc.broadcast((weights, class_bias, part_bias, tokens_in, types_in, total, distinct))
    return scratch.write(ready.drop("part").mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
