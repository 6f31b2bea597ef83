"""Slices of few words, patterned texts, rules under any name, tokenizers beyond the proof, texts beyond a slice."""

import json

import numpy as np
import pytest

from retrofit_spark.llm import arrowtext, counts, lm, near, repeats, secrets, units
from retrofit_spark.llm.units import load, tokenizer_path

from .conftest import SCHEMA, rows_of


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out[:n], out[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [64, 1024, 4096, 8192])
def test_hashes_of_patterned_words(size):
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse(size))
    whole = np.array([0]), np.array([size])
    assert arrowtext.SpanHash(a).of(*whole) != arrowtext.SpanHash(b).of(*whole)


def test_hashes_depend_on_bytes_alone():
    data = np.frombuffer(b"abcdefgh" * 100, np.uint8)
    hashes = arrowtext.SpanHash(data)
    for n in (0, 1, 7, 8, 9, 16, 63, 256, 257, 300):
        got = hashes.of(np.arange(8) * 8, np.arange(8) * 8 + n)
        assert len(set(got.tolist())) == 1
        assert n == 0 or got[0] != hashes.of(np.array([1]), np.array([1 + n]))[0]
    ends = np.arange(1, 600)
    assert len(set(hashes.of(np.zeros(599, np.int64), ends).tolist())) == 599


def test_patterned_words_stay_apart(spark):
    a, b = thue_morse(4096)
    docs = spark.createDataFrame(rows_of([a, b, f"{a} {a} {a} {a} {a} {a}", f"{b} {b} {b} {b} {b} {b}"]), SCHEMA).coalesce(1)
    assert {r.doc_id: r.n_class if "n_class" in r else r.class_size for r in near.near_classes(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    train = next(k for k in range(100, 200) if not lm_held(k))
    held = next(k for k in range(100, 200) if lm_held(k))
    two = spark.createDataFrame([(train, a), (held, b)], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in lm.score_documents(two).collect()} == {train: 2, held: 1}


def lm_held(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 7 == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_near_of_few_words(spark, parts):
    for texts in (["hello world"], ["one"], [""], [None], ["a b c"], ["a b c d"], ["a b c d e"], ["a b c d e f"], ["a", "a b", "a b c", "", "a b"], ["x " * 2]):
        docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(parts)
        assert near.near_classes(docs).count() == len(texts)


def test_near_of_a_long_text_of_two_words(spark):
    docs = spark.createDataFrame(rows_of(["y" * 3_000_000 + " z", "hello world", "y" * 3_000_000 + " z"]), SCHEMA)
    got = {r.doc_id: r.class_id for r in near.near_classes(docs).collect()}
    assert got[1] == got[3] and got[2] == 2


def test_rules_under_any_name(spark):
    docs = spark.createDataFrame([(1, "id DEADBEEF00 x"), (2, "id deadbeef00"), (3, "ABCDEF" * 3 + "é")], "doc_id long, text string")
    found = {}
    for name in ("hex", "upper"):
        got = secrets.find_secrets(docs, rules=(secrets.Rule(name, "[0-9A-F]{8,}", 0, 8),)).collect()
        found[name] = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in got}
    assert found["hex"] == found["upper"] == {1: [(3, 13)], 2: [], 3: [(0, 18)]}


NORMALISERS = [
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": ""}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": "_"}, {"type": "Replace", "pattern": {"String": " "}, "content": ""},
    {"type": "Strip", "strip_left": True, "strip_right": True}, {"type": "NFKC"}, {"type": "NFD"}, {"type": "StripAccents"}, {"type": "Prepend", "prepend": "x"}, {"type": "Lowercase"}, {"type": "NFC"},
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": ""}]}]},
]


@pytest.mark.parametrize("normaliser", NORMALISERS, ids=lambda x: json.dumps(x)[:60])
def test_tokenizers_with_any_normaliser(tmp_path, normaliser):
    made = json.loads(open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read())
    path = tmp_path / "t.json"
    path.write_text(json.dumps(made | {"normalizer": normaliser}), encoding="utf-8")
    texts = ["foo bar foo bar", " Foo, BAR baz!  foo ", "Ångström fi ｆｕｌｌ", "", "a  b\n\nc"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    ids, at = units.UnitEncoder(str(path)).encode(data, offsets)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == load(str(path)).encode(t, add_special_tokens=False).ids


def test_ranges_of_repeats_are_alike():
    rnd = np.random.default_rng(5)
    data = rnd.integers(97, 123, 200_000).astype(np.uint8)
    least = repeats.stretches(data, np.array([0, len(data)]))[3]
    share = np.bincount((least >> np.uint64(60)).astype(int), minlength=16) / len(least)
    assert share.max() < 2 / 16


def test_count_of_texts_beyond_a_slice(spark):
    text = ("Lorem ipsum, dolor sit amet. " * 120_000)[:3_200_000]
    docs = spark.createDataFrame(rows_of([text, None, "short one", text]), SCHEMA)
    want = len(load(tokenizer_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in counts.count_tokens(docs).collect()} == {1: want, 2: 0, 3: 2, 4: want}
