"""Token counts, with overlap resynchronisation for huge documents.

A document of up to 64 KB is counted in one go. A longer one is cut into chunks that overlap; the
chunks are rows of their own, spread over all tasks, and are encoded with offsets. Two neighbours
are spliced at the first place of their overlap where both encodings have a token boundary and
which is proven stable: a visible character before it, white space after it, so that neither
encoding could have depended on text beyond its chunk. Documents with an overlap that has no such
place go into another round with overlaps eight times as wide, until all are spliced; an overlap
as wide as the document is the plain encoding of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import text_slices
from .scratch import Scratch, documents
from .units import covered, encoder, load, tokenizer_path

CHUNK, OVERLAP, WIDER, LIMIT = 1 << 16, 1 << 9, 8, 1024

_CHUNKS = "row long, doc_id long, k int, last boolean, n_chars long, core long, begin long, text string"
_ZONES = "row long, doc_id long, k int, last boolean, n_bytes long, n_tokens long, head array<struct<at: long, before: long>>, tail array<struct<at: long, before: long>>"


def _splitter(chunk: int, overlap: int):
    """Chunks as rows. Each has `overlap` characters of context on both sides of its core."""

    def run(batches):
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                n = len(text)
                for k, core in enumerate(range(0, n, chunk)):
                    begin, end, last = max(0, core - overlap), min(n, core + chunk + overlap), core + chunk >= n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in ((row, pa.int64()), (doc_id, pa.int64()), (k, pa.int32()), (last, pa.bool_()), (n, pa.int64()), (core, pa.int64()), (begin, pa.int64()), (text[begin:end], pa.string()))],
                        ["row", "doc_id", "k", "last", "n_chars", "core", "begin", "text"],
                    )

    return run


def _stable(text: str, i: int) -> bool:
    return 0 < i < len(text) and text[i] in " \n\t" and (text[i - 1].isalnum() or "!" <= text[i - 1] <= "~")


def _zones(path: str, chunk: int, overlap: int):
    """For each chunk: its number of tokens, and of the stable token boundaries around its core's two ends, where they are and how many tokens come before."""

    def run(batches):
        tokenizer = load(path)
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                encoding = tokenizer.encode(x["text"], add_special_tokens=False)
                starts = [a for a, _ in encoding.offsets]

                def zone(low, high, x=x, starts=starts):
                    at = {}
                    for n, a in enumerate(starts):
                        if low <= a + x["begin"] < high and a not in at and _stable(x["text"], a):
                            at[a] = n
                    return [{"at": a + x["begin"], "before": n} for a, n in at.items()]

                end = x["core"] + chunk
                core = x["text"][x["core"] - x["begin"] : end - x["begin"]]
                out.append({k: x[k] for k in ("row", "doc_id", "k", "last")} | {
                    "n_bytes": len(core.encode()), "n_tokens": len(starts),
                    "head": zone(x["core"] - overlap, x["core"] + overlap) if x["k"] else [],
                    "tail": [] if x["last"] else zone(end - overlap, end + overlap),
                })
            yield from pa.Table.from_pylist(out, ZONE_SCHEMA).to_batches()

    return run


_ZONE = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
ZONE_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("last", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("head", _ZONE), ("tail", _ZONE)])


def _huge(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens of rows of (row, doc_id, text), spliced from chunks."""
    scratch, rest, done, step = Scratch(docs.sparkSession), docs, None, 0
    while True:
        pieces = rest.select("row", "doc_id", "text").mapInArrow(_splitter(chunk, overlap), _CHUNKS).repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism), "row", "k")
        zones = pieces.mapInArrow(_zones(path, chunk, overlap), _ZONES)
        # A chunk meets its successor: k of the one is k - 1 of the other.
        left = zones.select("row", "doc_id", "n_bytes", "n_tokens", "last", "tail", F.col("k").alias("join"), F.lit(True).alias("is_left"))
        right = zones.select("row", "head", (F.col("k") - 1).alias("join"))
        both = left.join(right, ["row", "join"], "left")
        both = both.withColumn("at", F.array_min(F.array_intersect(F.col("tail.at"), F.col("head.at"))))
        before = lambda zone: F.get(F.filter(zone, lambda z: z["at"] == F.col("at")), F.lit(0))["before"]
        # Tokens of the chunk up to its splice, less those of the next chunk before it.
        part = F.when(F.col("last"), F.col("n_tokens")).otherwise(before("tail") - before("head"))
        counted = both.groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(part).alias("n_tokens"), F.count_if(~F.col("last") & F.col("at").isNull()).alias("failed"))
        counted = scratch.write(counted, f"counted{step}")
        good = counted.where("failed = 0").select("doc_id", "n_bytes", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = counted.where("failed > 0").select("row")
        if failed.isEmpty():
            return done
        rest = scratch.write(rest.join(failed, "row", "left_semi"), f"rest{step}")
        step, overlap = step + 1, overlap * WIDER
        chunk = max(chunk, overlap)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty (0 tokens); repeated rows are counted each; an empty table gives none;
    other columns are ignored; a text of any length is counted whole.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        units = encoder(path)
        for rows, data, offsets in text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(units.count(data, offsets))], ["doc_id", "n_bytes", "n_tokens"])

    own = documents(docs, id_col, text_col)
    if not covered(load(path)):  # no boundary is proven stable
        return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    found = own.where(size <= chunk).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    huge = own.where(size > chunk)
    if not huge.isEmpty():
        huge = Scratch(docs.sparkSession).write(huge.withColumn("row", F.monotonically_increasing_id()), "huge")
        found = found.unionByName(_huge(huge, path, chunk, overlap))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
