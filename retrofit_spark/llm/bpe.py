"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 16 bytes cuts every text into chunks of about 512 bytes, so that passages which
documents share fall into the same chunks wherever they stand. A chunk is encoded once and looked
up from then on. What a chunk's encoding proves is its part between its first and last safe break
(see units.py); the join between two chunks, from the last safe break of the one to the first of
the other, is encoded again, and where a chunk has no safe break the join grows over it. At a safe break the
encodings on both sides are those of the whole text, so a join needs no second try, and the whole is exactly the
library's encoding.

Reuse reaches over all documents that one Python worker sees; the memo is bounded and cleared when
it is full, which costs time but never changes a result. Decoding puts the tokens' bytes together,
document by document, from a table made with the library's own vocabulary.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import SpanHash, mix, spread, text_slices
from .scratch import documents
from .units import UnitEncoder, distinct, encoder, load, tokenizer_path

WINDOW, MEAN_BITS, MEMO_CHUNKS = 16, 9, 30_000
_FIRST = np.uint64(0x9E3779B97F4A7C15)


def chunk_cuts(data: np.ndarray, hashes: SpanHash) -> np.ndarray:
    """Places where the hash of the 16 bytes before them has nine leading zeros."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    eights = hashes.eights
    rolled = mix(eights[: len(data) - WINDOW] * _FIRST + eights[8 : len(data) - WINDOW + 8])
    return np.flatnonzero(rolled >> np.uint64(64 - MEAN_BITS) == 0) + WINDOW


class ChunkEncoder:
    def __init__(self, units: UnitEncoder):
        self.units, self.memo, self.reused, self.encoded = units, {}, 0, 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows among them)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes, safe = SpanHash(data), self.units.breaks(data, offsets)
        edges = np.append(safe, len(data))
        cuts = chunk_cuts(data, hashes)
        # A cut becomes the two safe breaks around it: between them lies the join.
        before = edges[np.searchsorted(edges, cuts, "right") - 1]
        after = edges[np.searchsorted(edges, cuts, "left")]
        starts = np.unique(np.concatenate((offsets[:-1], before, after)))
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        first, inverse = distinct(data, starts, ends, hashes)
        raw = data.tobytes()
        chunks = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        found = [self.memo.get(c) for c in chunks]
        missing = [k for k, x in enumerate(found) if x is None]
        self.reused += len(starts) - len(missing)
        self.encoded += len(missing)
        if missing:
            if len(self.memo) + len(missing) > MEMO_CHUNKS:
                self.memo.clear()
            new = [chunks[k] for k in missing]
            at = np.concatenate(([0], np.cumsum([len(c) for c in new])))
            ids, bounds = self.units.encode(np.frombuffer(b"".join(new), np.uint8), at)
            blob, bounds = ids.tobytes(), (bounds * 4).tolist()
            for n, k in enumerate(missing):
                found[k] = blob[bounds[n] : bounds[n + 1]]
                if len(chunks[k]) <= 4096:
                    self.memo[chunks[k]] = found[k]
        sizes = np.array([len(x) for x in found], np.int64) >> 2
        flat = np.frombuffer(b"".join(found), np.uint32)
        counts = sizes[inverse]
        total = np.concatenate(([0], np.cumsum(counts)))
        return flat[spread((np.cumsum(sizes) - sizes)[inverse], counts)], total[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(encoder(path))


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens in turn, first, length): byte-level tokens spelled back into bytes, special tokens as they are written."""
    tokenizer = load(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    table = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, k in tokenizer.get_vocab(with_added_tokens=True).items():
        table[k] = bytes(spelled[c] for c in token) if all(c in spelled for c in token) else token.encode()
    for k, added in tokenizer.get_added_tokens_decoder().items():
        table[k] = added.content.encode()
    sizes = np.array([len(x) for x in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode_rows(ids: np.ndarray, offsets: np.ndarray, path: str) -> tuple[bytes, np.ndarray]:
    """(bytes of all rows, offsets); bytes that aren't UTF-8 are for the caller to replace."""
    flat, first, size = token_bytes(path)
    lengths = size[ids]
    return flat[spread(first[ids], lengths)].tobytes(), np.concatenate(([0], np.cumsum(lengths)))[offsets]


@lru_cache(maxsize=2)
def _decimals(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id's digits and a comma, padded by zero bytes; their number."""
    width = len(str(vocabulary)) + 1
    table = np.zeros((vocabulary, width), np.uint8)
    for k in range(vocabulary):
        digits = f"{k},".encode()
        table[k, : len(digits)] = list(digits)
    return table, (table > 0).sum(1)


def ids_as_text(ids: np.ndarray, offsets: np.ndarray, vocabulary: int) -> tuple[bytes, np.ndarray]:
    """(decimal ids, each with a comma after it, of all rows; offsets)."""
    table, size = _decimals(vocabulary)
    flat = table[ids].ravel()
    return flat[flat != 0].tobytes(), np.concatenate(([0], np.cumsum(size[ids])))[offsets]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (array of int). Null text counts as empty; repeated rows are encoded each; an empty table gives none."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        chunks = chunk_encoder(path)
        for rows, data, offsets in text_slices(batches):
            ids, bounds = chunks.encode(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of the rows of encode_documents()."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            raw, at = decode_rows(lists.flatten().to_numpy().astype(np.int64), bounds, path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded by chunk reuse, the ids decoded again, in one pass over the texts."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        chunks, vocabulary = chunk_encoder(path), load(path).get_vocab_size(with_added_tokens=True)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for rows, data, offsets in text_slices(batches):
            ids, bounds = chunks.encode(data, offsets)
            spelled, at = ids_as_text(ids, bounds, vocabulary)
            listed = [sha(spelled[a : max(a, b - 1)]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            raw, at = decode_rows(ids, bounds, path)
            decoded = [sha(raw[a:b].decode(errors="replace").encode()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds)), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
