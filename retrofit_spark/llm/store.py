"""Token ids in a content-addressed store.

The format, below one folder:

  format/              bytes of an id (2 or 4), the id that ends a document (null: none)
  objects/kind=chunk   digest (16 bytes of BLAKE2b over the ids' bytes), data: little-endian ids, one row for each distinct chunk
  objects/kind=document  root (as digest), doc_id, n_tokens, and its chunks' digests and sizes
  recipes/             documents in ascending doc_id: doc_id, start, nth, n_tokens, root
  manifest/            level, node, root: Merkle roots over ranges of documents, up to the single root of the corpus

A rolling hash over eight ids ends a chunk (about 256 ids, 2048 at most), so a passage that documents
share gives the same chunks in all of them. A document's root is the Merkle root of its digests.
Reading back checks every chunk against its digest, every document against its root, and the
manifest against the documents.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtext import text_slices
from .scratch import Scratch, documents
from .units import encoder, load, tokenizer_path

WINDOW, MEAN_BITS, MOST, FANOUT = 8, 8, 2048, 1024
#: Text encoded at once: more than elsewhere, as stretches that are met again in it cost nothing.
ENCODED_BYTES = 4 << 20
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 1 << 17, dtype=np.uint64)


def chunk_ends(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all documents, ascending, the documents' own ends among them; empty documents have none."""
    n = len(ids)
    gear = _MIX[ids & 0x1FFFF]
    span = 1
    while span < WINDOW:  # the hash of the last 2, 4, 8 ids
        wide = gear.copy()
        wide[span:] = gear[span:] * np.uint64(0xD6E8FEB86659FD93) + gear[:-span]
        gear, span = wide, span * 2
    cut = np.zeros(n + 1, bool)
    cut[1:] = gear >> np.uint64(64 - MEAN_BITS) == 0
    cut[bounds] = True
    ends = np.flatnonzero(cut)
    gaps = np.diff(ends)
    if (gaps > MOST).any():  # even steps within an overlong run
        more = [np.arange(a + MOST, b, MOST) for a, b in zip(ends[:-1][gaps > MOST], ends[1:][gaps > MOST], strict=True)]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends[ends > 0]


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a lone node rises unchanged."""
    level = [address(b"\0" + x) for x in leaves] or [address(b"")]
    while len(level) > 1:
        level = [address(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_FORMAT = "id_bytes int, end_id long"
_ROWS = "digest binary, doc_id long, n_tokens long, sizes binary, data binary"
ROW_SCHEMA = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("sizes", pa.binary()), ("data", pa.binary())])


def _rows(path: str, end_id: int | None, width: str):
    """A row for each chunk that this task hasn't given yet (n_tokens null), and one for each document (its digests in data)."""

    def run(batches):
        units, given = encoder(path), set()
        for rows, data, offsets in text_slices(batches, limit=ENCODED_BYTES):
            ids, bounds = units.encode(data, offsets)
            if end_id is not None:
                ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
            ends = chunk_ends(ids, bounds)
            raw, size = ids.astype(width).tobytes(), np.dtype(width).itemsize
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            keys = [address(raw[a:b]) for a, b in zip((starts * size).tolist(), (ends * size).tolist(), strict=True)]
            new = []
            for k, key in enumerate(keys):
                if key not in given:
                    given.add(key)
                    new.append(k)
            per_doc = np.searchsorted(ends, bounds, "right")
            sizes = (ends - starts).astype("<u4")
            doc_ids, digests, recipes, lengths = rows.column(0), [], [], []
            for i, (a, b) in enumerate(zip(per_doc[:-1].tolist(), per_doc[1:].tolist(), strict=True)):
                recipes.append(b"".join(keys[a:b]))
                lengths.append(sizes[a:b].tobytes())
                digests.append(merkle(keys[a:b]))
            n, m = len(digests), len(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digests + [keys[k] for k in new], pa.binary()),
                    pa.concat_arrays([doc_ids.cast(pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(np.diff(bounds).astype(np.int64)), pa.nulls(m, pa.int64())]),
                    pa.array(lengths + [None] * m, pa.binary()),
                    pa.array(recipes + [raw[starts[k] * size : ends[k] * size] for k in new], pa.binary()),
                ],
                schema=ROW_SCHEMA,
            )

    return run


def _once(batches):
    """Chunks that this partition hasn't seen yet; documents all."""
    seen = set()
    for batch in batches:
        digests, counts = batch.column(0).to_pylist(), batch.column(2)
        keep = np.ones(batch.num_rows, bool)
        for k in np.flatnonzero(counts.is_null().to_numpy(zero_copy_only=False)):
            keep[k] = digests[k] not in seen
            seen.add(digests[k])
        yield batch.filter(pa.array(keep))


def write_store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 1) -> None:
    """Encode every document, append `end_id`, and write the store.

    Null text counts as empty. Repeated rows are documents of their own, ties of doc_id in the order of their
    roots. A null doc_id comes first. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path("word_bpe_49k.json")
    width = "<u2" if load(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    spark.createDataFrame([(np.dtype(width).itemsize, end_id)], _FORMAT).write.parquet(f"{folder}/format")
    rows = documents(docs, id_col, text_col).mapInArrow(_rows(path, end_id, width), _ROWS)
    spread = F.when(F.col("n_tokens").isNull(), F.col("digest")).otherwise(F.concat("digest", F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary")))
    kind = F.when(F.col("n_tokens").isNull(), "chunk").otherwise("document")
    rows.repartition(spread).mapInArrow(_once, _ROWS).withColumn("kind", kind).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/objects")
    recipes = _objects(spark, folder, "document")
    order = ["doc_id", "digest"]
    placed = recipes.select("doc_id", "n_tokens", "digest").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = Scratch(spark).write(placed.mapInArrow(_running, "doc_id long, n_tokens long, digest binary, part int, local long, nth long"), "placed")
    parts = placed.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    index = placed.join(F.broadcast(parts), "part").select("doc_id", (F.col("local") + F.col("tokens_before")).alias("start"), (F.col("nth") + F.col("rows_before")).alias("nth"), "n_tokens", F.col("digest").alias("root"))
    index.write.parquet(f"{folder}/recipes")
    _manifest(spark, folder)


def _running(batches):
    """Running sums over a sorted partition."""
    from pyspark import TaskContext

    part, tokens, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column(1).to_numpy().astype(np.int64)
        after = np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(tokens + after - n), pa.array(rows + np.arange(len(n), dtype=np.int64))],
            ["doc_id", "n_tokens", "digest", "part", "local", "nth"],
        )
        tokens, rows = tokens + (int(after[-1]) if len(n) else 0), rows + len(n)


def _width(spark: SparkSession, folder: str) -> str:
    return f"<u{spark.read.schema(_FORMAT).parquet(f'{folder}/format').head().id_bytes}"


def _objects(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{_ROWS}, kind string").parquet(f"{folder}/objects").where(F.col("kind") == kind).drop("kind")


def _levels(index: DataFrame) -> list[DataFrame]:
    """Merkle nodes, from ranges of FANOUT documents upwards to the root: level, node, root."""

    def up(df, level):
        node = F.floor(F.col("nth") / FANOUT).alias("nth")
        leaves = F.transform(F.array_sort(F.collect_list(F.struct("nth", "root"))), lambda x: F.hex(x["root"]))
        return df.groupBy(node).agg(F.unhex(F.sha2(F.array_join(leaves, ","), 256)).alias("root")).withColumn("level", F.lit(level))

    spark, rows, out, now = index.sparkSession, index.count(), [], index.select("nth", "root")
    scratch = Scratch(spark)
    while True:
        now = scratch.write(up(now, len(out)), f"level{len(out)}")
        out.append(now.select("level", F.col("nth").alias("node"), "root"))
        rows = -(-rows // FANOUT)
        if rows <= 1:
            return out


def _manifest(spark: SparkSession, folder: str) -> None:
    for k, level in enumerate(_levels(spark.read.parquet(f"{folder}/recipes"))):
        level.write.mode("append" if k else "overwrite").parquet(f"{folder}/manifest")


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 polynomial, bit-reflected."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    b = b + np.zeros_like(out)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


def crc_shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32s moved past so many bytes: crc32(a + b) = crc_shifted(crc32(a), len(b)) ^ crc32(b)."""
    power, factor, left = np.array([1 << 23], np.uint32), crc.astype(np.uint32), zeros.astype(np.uint64)  # x**8
    while left.any():
        factor = np.where(left & np.uint64(1), _multiply(factor, power), factor)
        power, left = _multiply(power, power), left >> np.uint64(1)
    return factor


def _read_chunks(width: str):
    """digest, crc, ok of every chunk, from its bytes."""

    def run(batches):
        for batch in batches:
            digests, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, width).astype("<u4").tobytes()) for x in data]
            ok = [address(x) == d for d, x in zip(digests, data, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(ok), pa.array([len(x) // np.dtype(width).itemsize for x in data], pa.int64())], ["digest", "crc", "ok", "size"])

    return run


def _read_recipes(batches):
    """A row for each document's chunk: where it stands and how many bytes of uint32 ids come after it; the document's root is checked."""
    for batch in batches:
        counts, roots, sizes, keys = (c.to_pylist() for c in batch.columns[1:])
        parts, after, want, good, n_parts = [], [], [], [], []
        for n, root, packed, joined in zip(counts, roots, sizes, keys, strict=True):
            size = np.frombuffer(packed, "<u4").astype(np.int64)
            own = [joined[i : i + 16] for i in range(0, len(joined), 16)]
            good.append(merkle(own) == root and int(size.sum()) == n and len(size) == len(own))
            n_parts.append(max(1, len(own)))
            parts += own or [None]
            after.append((n - np.cumsum(size)) * 4 if own else np.zeros(1, np.int64))
            want.append(size if own else np.zeros(1, np.int64))
        times = np.array(n_parts, np.int64)
        if len(times):
            of = pa.array(np.repeat(np.arange(len(times)), times))
            place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(2).take(of), pa.array(place), pa.array(parts, pa.binary()), pa.array(np.concatenate(after)), pa.array(np.concatenate(want)), pa.array(np.repeat(np.array(good), times))],
                ["doc_id", "root", "k", "digest", "after", "want", "good"],
            )


def _shift(batches):
    for batch in batches:
        crc, after = batch.column(1).fill_null(0).to_numpy().astype(np.uint32), batch.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc_shifted(crc, after).astype(np.int64)), batch.column(3)], ["key", "crc", "bad"])


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone; a damaged chunk, recipe or manifest raises.

    The ids' checksum is put together from the checksums of the chunks read, so ids needn't be moved.
    """
    chunks = _objects(spark, folder, "chunk").select("digest", "data").mapInArrow(_read_chunks(_width(spark, folder)), "digest binary, crc long, ok boolean, size long")
    documents_ = _objects(spark, folder, "document").select("doc_id", "n_tokens", F.col("digest").alias("root"), "sizes", F.col("data").alias("keys"))
    index = spark.read.parquet(f"{folder}/recipes")
    # Documents with one content share their checksum: one of them is put together for all.
    recipes = documents_.mapInArrow(_read_recipes, "doc_id long, root binary, k long, digest binary, after long, want long, good boolean")
    parts = recipes.groupBy("root", "k", "digest", "after", "want").agg(F.bool_and("good").alias("good"))
    found = parts.join(chunks, "digest", "left")
    bad = ~(F.col("good") & (F.col("digest").isNull() | (F.coalesce(F.col("ok"), F.lit(False)) & (F.col("size") == F.col("want")))))
    moved = found.select(F.col("root").alias("key"), "crc", "after", bad.alias("bad")).mapInArrow(_shift, "key binary, crc long, bad boolean")
    sums = moved.groupBy("key").agg(F.bit_xor("crc").alias("ids_crc32"), F.bool_or("bad").alias("bad"))
    checked = F.when(F.col("bad") | F.col("bad").isNull(), F.raise_error(F.lit("the store is damaged")).cast("long")).otherwise(F.col("ids_crc32"))
    return index.join(sums, F.col("root") == F.col("key"), "left").select("doc_id", "start", "n_tokens", checked.alias("ids_crc32"))


def verify_manifest(spark: SparkSession, folder: str) -> bool:
    """Whether the manifest is that of the recipes."""
    kept = spark.read.parquet(f"{folder}/manifest")
    for level in _levels(spark.read.parquet(f"{folder}/recipes")):
        wrong = level.join(kept, ["level", "node"], "left").where(~level["root"].eqNullSafe(kept["root"]))
        if not wrong.isEmpty():
            return False
    return True


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids of each document, reconstructed."""
    width = _width(spark, folder)
    chunks = _objects(spark, folder, "chunk").select("digest", "data")
    recipes = _objects(spark, folder, "document").select("doc_id", "n_tokens", F.col("digest").alias("root"), "sizes", F.col("data").alias("keys")).dropDuplicates(["root"])
    parts = recipes.mapInArrow(_read_recipes, "doc_id long, root binary, k long, digest binary, after long, want long, good boolean")
    whole = parts.join(chunks, "digest", "left").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("k", "data"))).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["data"] or b"" for p in parts), width).astype(np.int64) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["root", "ids"])

    return spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", "root").join(whole.mapInArrow(run, "root binary, ids array<long>"), "root").select("doc_id", "start", "ids")


def stored_summary(docs: DataFrame, **options) -> DataFrame:
    """Write a store into the shared folder and read it back."""
    scratch = Scratch(docs.sparkSession)
    write_store(docs, f"{scratch.root}/store", **options)
    if not verify_manifest(docs.sparkSession, f"{scratch.root}/store"):
        raise ValueError("the manifest isn't that of the recipes")
    return read_summary(docs.sparkSession, f"{scratch.root}/store")
