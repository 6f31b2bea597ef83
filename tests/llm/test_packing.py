import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from retrofit_spark.llm import packing
from retrofit_spark.llm.units import load, tokenizer_path

from .conftest import SCHEMA, rows_of


def laid_out(plan):
    """(sequence, offset, length) of every piece of a plan, and the number of pieces of each length."""
    out, numbers = [], Counter()
    for length, first, count, each, base, offset in sorted(plan.intervals):
        assert first == numbers[length]
        numbers[length] += count
        out += [(base + k // each, offset + k % each * length, length) for k in range(count)]
    return out, numbers


def best_fit_decreasing(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = min((k for k, r in enumerate(rooms) if r >= n), key=lambda k: rooms[k], default=None)
        if at is None:
            rooms.append(size - n)
        else:
            rooms[at] -= n
    return len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([16, 64, 200]))
    lengths = np.clip([rng.integers(1, size + 1, 150), rng.lognormal(2, 1, 300), rng.integers(size // 3, size // 2 + 2, 90), rng.integers(0, 0, 0), np.full(77, size // 2 + 1), np.full(9, size)][seed % 6], 1, size).astype(int)
    plan = packing.plan(np.bincount(lengths, minlength=size + 1), size, groups=int(rng.integers(1, 30)))
    pieces, numbers = laid_out(plan)
    assert numbers == Counter(lengths.tolist())
    ends = defaultdict(int)
    for sequence, offset, length in sorted(pieces):
        assert offset == ends[sequence]
        ends[sequence] += length
    assert len(ends) == plan.sequences and max(ends.values(), default=0) <= size
    assert -(-int(lengths.sum()) // size) <= plan.sequences <= best_fit_decreasing(lengths.tolist(), size)


def test_configurations_beat_best_fit():
    """46 + 27 + 27 is full, 300 times; best fit puts 46 + 46 and 27 + 27 + 27 together, 150 and 200 times."""
    counts = np.zeros(101, np.int64)
    counts[[46, 27]] = 300, 600
    assert packing.plan(counts, 100).sequences <= 302 and best_fit_decreasing([46] * 300 + [27] * 600, 100) == 350
    sizes, demand = packing.grouped(counts, 13, 128)
    columns, often = packing.configurations(sizes, demand, 100)
    assert ((columns * sizes[:, None]).sum(0) <= 100).all() and (columns @ often <= demand).all() and (columns @ often >= 0.9 * demand).all()


def test_groups_have_equal_cardinality():
    counts = np.bincount(np.random.default_rng(2).integers(1, 2048, 10_000), minlength=2049)
    sizes, many = packing.grouped(counts, 257, 64)
    assert many.sum() == counts[257:].sum() and len(sizes) <= 64 and (many[:-1] == many[0]).all()
    assert (np.diff(sizes) < 0).all() and packing.grouped(np.zeros(2049, np.int64), 257, 64)[0].size == 0


def test_numbers_go_on_over_batches():
    seen = np.zeros(9, np.int64)
    assert packing.numbered(np.array([3, 3, 8, 3]), seen).tolist() == [0, 1, 0, 2]
    assert packing.numbered(np.array([8, 2, 3]), seen).tolist() == [1, 0, 3]
    assert packing.numbered(np.zeros(0, np.int64), seen).tolist() == []


@pytest.mark.parametrize("size", [2048, 50])
def test_pack(spark, docs, size):
    """Every row's ids come back from its pieces, and pieces fill sequences without gaps."""
    tokenizer = load(tokenizer_path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    packed = packing.pack(docs, size=size).cache()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)]
        want.update((i, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want and all(r.length == len(r.ids) for r in got)
    filled = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == len(filled[r.sequence_id])
        filled[r.sequence_id] += r.ids
    assert max(map(len, filled.values())) <= size
    assert len(filled) <= best_fit_decreasing([r.length for r in got], size)
    assert {r.sequence_id: r.ids for r in packing.sequences(packed).collect()} == filled
    digest = packing.digest(packed)
    assert digest.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in digest.collect()) == Counter((i, k, zlib.crc32(np.array(x, "<u4").tobytes())) for (i, k, _, x), n in want.items() for _ in range(n))


def test_pack_edges(spark, nothing):
    assert packing.digest(packing.pack(nothing)).count() == 0
    docs = spark.createDataFrame(rows_of([None, "", "a"]), SCHEMA)
    assert sorted((r.doc_id, r.length, r.sequence_id) for r in packing.pack(docs).collect()) == [(1, 1, 0), (2, 1, 0), (3, 2, 0)]
    long = spark.createDataFrame(rows_of(["word " * 700_000, "word", None]), SCHEMA)
    got = packing.pack(long).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: -(-700_002 // 2048), 2: 1, 3: 1}


def test_stretches_are_encoded_together(monkeypatch):
    """The library is called for texts of some KB, not for each stretch, and gives the ids of whole texts: special strings, marks after digits, white space at ends, Latin letters, nothing."""
    from retrofit_spark.llm import units

    path = units.tokenizer_path("byte_bpe_50k.json")
    texts = ["", " ", "a", "x1.", "<|endoftext|>", "Zoë, naïve (42). 7, 8; 中文 \n\n end  ", "<|endo", "ftext|> .", " b ́c", "  lead", "tail  ", ".", "\U0001f600 ok!", " ".join(f"word{k} x{k}a, y.{k}\t{k % 7}" for k in range(3000))]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    encoder, asked = units.UnitEncoder(path), []

    class Counting:
        def encode_batch_fast(self, some, **options):
            asked.extend(some)
            return units.load(path).encode_batch_fast(some, **options)

    encoder.tokenizer = Counting()
    ids, at = encoder.encode(data, offsets)
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == units.load(path).encode(text, add_special_tokens=False).ids, text
    assert len(asked) < len(encoder.memo) / 2
