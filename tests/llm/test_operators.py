"""Operators against brute force over texts with nulls, empties, copies, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from retrofit_spark.llm import bpe, counts, decontaminate, exact, induced, keeping, lm, near, quality, repeats, secrets, store, trigrams, units

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda t: hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def all_rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_secrets(docs, nothing):
    got = Counter(tuple(r) for r in secrets.digest(secrets.find_secrets(docs)).collect())
    want = Counter()
    kinds = ("assign", "access", "hex")
    for i, t in all_rows(docs):
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in secrets.RULES[0].compiled.finditer(t) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(base))
        want[(i, *(sum(k == n for _, k, _ in base) for n in range(3)), sha(text), secrets.brute(t))] += 1
    assert got == want and sum(r[1] for r in got) == 3
    assert secrets.find_secrets(nothing).count() == 0


def test_trigram_queries():
    key = next(r for r in secrets.RULES if r.kind == "assign").query()
    assert frozenset({"api", "pi_", "i_k", "_ke", "key"}) in key and frozenset({"api", "pik", "ike", "key"}) in key
    assert not next(r for r in secrets.RULES if r.kind == "hex").query()
    queries = {r.kind: r.query() for r in secrets.RULES}
    assert queries["access"] == {frozenset({"aki", "kia"})} and queries["jwt"] == {frozenset({"eyj"})}
    assert {"beg", "e k"} <= next(iter(queries["private_key"])) and {"ati", "bea"} <= next(iter(queries["bearer"]))


#: Patterns, and texts that each of them matches.
PATTERNS = [
    (r"abc|xyzw", ["abc", "xyzw"]), (r"(?:ab){2,5}c", ["ababc", "abababababc"]), (r"colou?r", ["color", "colour"]), (r"gr[ae]y+", ["gray", "greyyy"]),
    (r"(?i)straße", ["Straße", "STRAßE"]), (r"(?i)key", ["key", "KEY", "\u212aey"]), (r"a.c", ["a-c"]), (r"a[^b]cde", ["azcde"]), (r"(abc)\1", ["abcabc"]), (r"x*abc\b", ["xxabc", "abc"]),
    (r"(?=abc)[a-z]+", ["abcd"]), (r"(?:foo|ba)(?:bar|r)", ["foobar", "bar", "foor", "babar"]), (r"[abc][abc][abc][abc][abc]", ["abcab"]), (r"(?>tok|to)en_\w+", ["token_1"]),
    (r"日本語", ["日本語"]), (r"a{3}", ["aaa"]), (r"(?:abc)?(?:def)?", [""]), (r"[\w]key", ["akey"]), (r"sk_(live|test)_[0-9a-z]{8,}", ["sk_live_12345678", "sk_test_abcdefgh9"]), (r"(?i:GHP)_x", ["ghp_x", "GhP_x"]),
]


@pytest.mark.parametrize("flags", [0, re.ASCII])
def test_trigram_queries_of_any_pattern(flags):
    """A text with a match has all trigrams of one of the query's sets."""
    for pattern, texts in PATTERNS:
        query = trigrams.query_of(pattern, flags)
        for t in texts:
            if re.search(pattern, t, flags):
                seen = t.encode().lower().decode("latin-1")
                assert not query or any(all(x in seen for x in s) for s in query), (pattern, t, query)
            else:
                assert flags and "\u212a" in t
    assert trigrams.query_of(r"sk_(live|test)_[0-9a-z]{8,}") == {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in ("sk_live_", "sk_test_")}
    assert all(not trigrams.query_of(p) for p in (r"a.c", r"(?:abc)?", r"abc|x", r"", r"[0-9a-f]{32}"))


def test_secrets_of_rules_given_as_patterns(spark, docs):
    rules = (secrets.Rule("ids", r"qu(?:sto|lum)\w*", 0, 0), secrets.Rule("long", r"日本.のテキ", 0, 0), secrets.Rule("any", r"z{3}|\d{4}", 0, 4))
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in secrets.find_secrets(docs, rules=rules).collect())
    want = Counter((i, tuple((rules[k].kind, a, b) for a, k, b in secrets.scan_text(t or "", rules))) for i, t in all_rows(docs))
    assert got == want and sum(len(spans) for _, spans in got) > 20


def test_exact(docs, nothing):
    rows, got = all_rows(docs), exact.exact_dedup(docs).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    want = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, top, len(ids), sha(t))] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact.exact_dedup(nothing).count() == 0


def test_exact_long_texts(spark):
    """Texts of 20 MB: two equal ones, one that differs in its last byte only; they end after few rounds."""
    long = "abcdefghij" * 2_000_000
    table = spark.createDataFrame([(1, long), (2, long[:-1] + "!"), (3, long), (4, "short")], "doc_id long, text string")
    got = exact.exact_dedup(table)
    assert {tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept").collect()} == {(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)}


def brute_hits(text, windows):
    w, hit, items = words(text), set(), set()
    for item, g in windows:
        for s in range(len(w) - len(g) + 1):
            if w[s : s + len(g)] == g:
                hit |= set(range(s, s + len(g)))
                items.add(str(item))
    return len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)


@pytest.mark.parametrize("slots", [1 << 23, 64])
@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_decontaminate(spark, docs, nothing, texts, slots, threshold, monkeypatch):
    """Whichever join Spark picks, and if the filter passes words by chance."""
    monkeypatch.setattr(decontaminate, "SLOTS", slots)
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, threshold)
    try:
        _decontaminate(spark, docs, nothing, texts)
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)


def _decontaminate(spark, docs, nothing, texts):
    passage = texts[13]
    items = [(1, passage), (10, "One"), (2, "one two"), (3, None), (4, ""), (5, " ".join(words(texts[6])[5:30])), (5, " ".join(words(texts[6])[5:30])), (7, "not there at all")]
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = {(i, tuple(w[s : s + 10])) for i, t in items for w in [words(t)] if w for s in range(max(1, len(w) - 9))}
    want = Counter((i, *brute_hits(t, [(k, list(g)) for k, g in windows])) for i, t in all_rows(docs))
    assert Counter(tuple(r) for r in decontaminate.decontaminate(docs, table).collect()) == want
    assert decontaminate.decontaminate(nothing, table).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, table.limit(0)).collect())


def test_bpe(docs, nothing):
    tokenizer = units.load(units.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in all_rows(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs).collect()) == want
    encoded = bpe.encode_documents(docs)
    assert Counter((r.doc_id, r.text) for r in bpe.decode_documents(encoded).collect()) == Counter((i, t or "") for i, t in all_rows(docs))
    assert bpe.round_trip(nothing).count() == 0


def test_encoders_on_odd_texts():
    rnd = random.Random(5)
    parts = ["a", "B ", " c", "  ", "\n", "\t", "'s", "' s", "é", "É", "É.", "×.", " ", " ", "\x85", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "12.", "...", "!)", "日本", "é", "H̱", "İ", "K", "Σ", "́"]
    rows = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    data, at = np.frombuffer("".join(rows).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(r.encode()) for r in rows])))
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        u = units.UnitEncoder(units.tokenizer_path(name))
        want = [e.ids for e in u.tokenizer.encode_batch(rows, add_special_tokens=False)]
        for encoder in (u, bpe.ChunkEncoder(u)):
            ids, bounds = encoder.encode(data, at)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
        assert u.count(data, at).tolist() == [len(w) for w in want]


def test_store(spark, docs, nothing, tmp_path):
    tokenizer = units.load(units.tokenizer_path("word_bpe_49k.json"))
    rows = sorted(((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in all_rows(docs)), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted((tuple(r) for r in store.stored_summary(docs).collect()), key=lambda r: r[1])
    start = 0
    for (i, ids), r in zip(rows, got, strict=True):
        assert r == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = str(tmp_path / "store")
    store.write_store(docs, folder)
    assert Counter((r.doc_id, tuple(r.ids)) for r in store.read_ids(spark, folder).collect()) == Counter((i, tuple(x)) for i, x in rows)
    digests = [r.digest for r in store._objects(spark, folder, "chunk").collect()]
    assert len(digests) == len(set(digests)) and store.verify_manifest(spark, folder)
    assert store.stored_summary(nothing).count() == 0


def test_store_damage(spark, docs, tmp_path):
    folder, bad = str(tmp_path / "store"), str(tmp_path / "bad")
    store.write_store(docs, folder)
    rows = spark.read.parquet(f"{folder}/objects")
    rows.selectExpr("digest", "doc_id", "n_tokens", "sizes", "if(n_tokens is null, concat(substring(data, 3), x'0101'), data) AS data", "kind").write.partitionBy("kind").parquet(f"{bad}/objects")
    for name in ("recipes", "format"):
        spark.read.parquet(f"{folder}/{name}").write.parquet(f"{bad}/{name}")
    with pytest.raises(Exception, match="damaged"):
        store.read_summary(spark, bad).collect()


def tokenizer_file(tmp_path, size, pattern=None):
    """A byte-level tokenizer without training: all bytes, a few merges, and names up to `size`."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    vocabulary = {c: k for k, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    merges = [(".", "\u010a"), ("b", "a"), ("ba", "r"), ("!", "\u010a")]
    vocabulary |= {a + b: len(vocabulary) + k for k, (a, b) in enumerate(merges)}
    vocabulary |= {f"name{k}": k for k in range(len(vocabulary), size)}
    made = Tokenizer(models.BPE(vocab=vocabulary, merges=merges))
    split = [pre_tokenizers.Split(Regex(pattern), "isolated")] if pattern else []
    made.pre_tokenizer = pre_tokenizers.Sequence([*split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]) if pattern else pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.save(str(tmp_path / "made.json"))
    return str(tmp_path / "made.json"), made


@pytest.mark.parametrize(("size", "pattern"), [(70_001, None), (400, r"[^\n]+\n?")])
def test_other_tokenizers(spark, tmp_path, size, pattern):
    """A vocabulary beyond 16 bits, and a pattern that the proof of safe breaks doesn't cover."""
    path, made = tokenizer_file(tmp_path, size, pattern)
    rows = [(k, t) for k, t in enumerate(["foo.\nbar.\nbaz!\nqux", "bar. bar", "", None, "bar.\n" * 200])]
    want = [(k, made.encode(t or "", add_special_tokens=False).ids) for k, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, list(r.ids)) for r in bpe.encode_documents(docs, path=path).collect()) == want
    assert sorted((r.doc_id, r.n_tokens) for r in counts.count_tokens(docs, path=path, chunk=64, overlap=8).collect()) == [(k, len(x)) for k, x in want]
    got = sorted((r.doc_id, r.ids_crc32) for r in store.stored_summary(docs, path=path, end_id=size - 1).collect())
    assert got == [(k, zlib.crc32(np.array([*x, size - 1], "<u4").tobytes())) for k, x in want]


def test_crc_shift():
    rnd = np.random.default_rng(1)
    a, b = rnd.bytes(100), rnd.bytes(77)
    assert int(store.crc_shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - 49):
                first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        runs = int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))) if len(b) else 0
        yield i, len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))


def test_repeats(docs, nothing, monkeypatch):
    want = Counter(brute_repeats(all_rows(docs)))
    assert Counter(tuple(r) for r in repeats.remove_repeats(docs).collect()) == want and sum(r[2] for r in want) > 1000
    assert repeats.remove_repeats(nothing).count() == 0


def test_repeats_of_rows_in_different_blocks(spark, monkeypatch):
    """Rows of one doc_id that partly repeat an earlier document, one to a block."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    shared, tail, rest = (" ".join(word() for _ in range(n)) for n in (9, 60, 60))
    rows = [(5, rest + shared), (7, shared + tail), (7, shared + tail), (7, tail + shared), (9, tail)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_repeats(rows))


def test_induced_sorting(monkeypatch):
    rnd = random.Random(2)
    for held in (1 << 20, 64):  # in memory, and from disk
        monkeypatch.setattr(induced, "HELD_BYTES", held)
        for _ in range(60):
            letters = [1, 2, 3, 200, 256][: rnd.randint(1, 5)]
            symbols = [rnd.choice(letters) for _ in range(rnd.randint(1, 150))] + [0]
            order = induced.sort_suffixes(np.array(symbols, np.uint16)).tolist()
            keys = [(symbols[p:] + [0] * 60)[:50] for p in order]
            assert sorted(order) == list(range(len(symbols))) and keys == sorted(keys)


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 512), (1000, 8)])
def test_counts(docs, nothing, chunk, overlap):
    tokenizer = units.load(units.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in all_rows(docs):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    assert Counter(tuple(r) for r in counts.count_tokens(docs, chunk=chunk, overlap=overlap).collect()) == want
    assert counts.count_tokens(nothing).count() == 0


def test_lm(docs, nothing):
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + ["\0end"]) for i, t in all_rows(docs)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in t)
    total, distinct = sum(c.values()), len(c)
    got = lm.score_documents(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = sorted(((i, held(i), len(t), sum(w in c for w in t), total, sum(log10((c[w] + 1) / (total + distinct + 1)) for w in t)) for i, t in rows), key=key)
    for r, w in zip(sorted((tuple(r) for r in got), key=key), want, strict=True):
        assert r[:5] == w[:5] and r[5] == pytest.approx(w[5])
        assert w[2] * log10(lm.BASE_SHARE) + r[5] - 1e-6 <= r[6] < 0
    assert lm.score_documents(nothing).count() == 0


def test_lm_learns_from_histories(spark):
    """Held-out texts of a language in which a word depends on the one before: the score beats the base by a fifth of it, and that of the same words shuffled."""
    rnd = random.Random(5)
    words_ = [f"w{k}" for k in range(300)]
    after = {w: rnd.sample(words_, 3) for w in words_}
    rows = []
    for k in range(600):
        text = [rnd.choice(words_)]
        while len(text) < 120:
            text.append(rnd.choice(after[text[-1]]))
        rows.append((k, " ".join(text)))
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 7 == 2]
    shuffled = {}
    for k in held[::2]:
        text = rows[k][1].split(" ")
        rnd.shuffle(text)
        rows[k] = (k, " ".join(text))
        shuffled[k] = True
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fluent = [got[k] for k in held if k not in shuffled]
    mean = lambda rs, f: float(np.mean([f(r) for r in rs]))
    assert mean(fluent, lambda r: r.score) > 0.8 * mean(fluent, lambda r: r.base_score)
    assert mean(fluent, lambda r: r.score / r.n_tokens) > mean([got[k] for k in shuffled], lambda r: r.score / r.n_tokens) + 0.3


def test_lm_distribution():
    """Both softmaxes sum to one, a leaf's words and its unseen one share it, and a step of training raises the likelihood."""
    rnd = np.random.default_rng(3)
    rows, classes = rnd.integers(0, 50, (3, 500)) + np.arange(3)[:, None] * lm.BUCKETS, rnd.integers(0, lm.CLASSES, 500)
    weights, bias = np.zeros((3 * lm.BUCKETS, lm.CLASSES), np.float32), np.zeros(lm.CLASSES, np.float32)
    before = lm.log_softmax(weights, bias, rows)
    lm.update(weights, bias, rows, classes)
    after = lm.log_softmax(weights, bias, rows)
    assert np.allclose(np.exp(after).sum(1), 1, atol=1e-5)
    assert after[np.arange(500), classes].sum() > before[np.arange(500), classes].sum()


def test_quality(spark, nothing):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no test data")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(nothing, labels).count() == 0


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 60)] + [(61, None, 0), (9999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or isnan(score) or score < 0 or score > 1").count() == 0
    one = quality.classify(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert [r.score for r in one] == [1.0]
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels.where("quality = 1"))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_quality_vectors_of_all_documents(spark):
    """The corpus statistics don't depend on the rows that the network is fitted on."""
    rnd = random.Random(13)
    rows = [(k, " ".join(rnd.choice("abcdefghij") + rnd.choice("klmnop") for _ in range(30))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(k, k % 2) for k in range(60)]
    all_of_them, few = (quality.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, labels[:12]))
    assert all_of_them.network is not None and few.network is not None
    assert np.allclose(all_of_them.vectors, few.vectors)


def classes_by_force(rows):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = words(t)
        sets.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    df = Counter(s for c in sets if c for s in c)
    factor = lambda s: 1 - near.SPAN + near.SPAN * min(1, max(0, np.log(df[s] / len(rows)) / np.log(near.SHARE)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] is None or sets[b] is None:
                same = sets[a] is None and sets[b] is None and (rows[a][1] or "") == (rows[b][1] or "")
            else:
                x, y = sets[a], sets[b]
                least = sum(factor(s) * min(n, y[s]) for s, n in x.items() if s in y)
                most = sum(factor(s) * max(x[s], y[s]) for s in x.keys() | y.keys())
                same = least / most >= near.THRESHOLD
            if same:
                parent[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return Counter((i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids)


def test_near(spark, docs, nothing):
    assert Counter(tuple(r) for r in near.near_classes(docs).collect()) == classes_by_force(all_rows(docs))
    assert near.near_classes(nothing).count() == 0


def test_near_large_groups(spark):
    """A group of near copies larger than a small bucket, and many texts around one common passage that aren't copies."""
    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rnd.choice(letters) for _ in range(5))
    base, passage, rows = [word() for _ in range(150)], [word() for _ in range(60)], []
    for _ in range(90):
        copy = list(base)
        for k in rnd.sample(range(150), 2):
            copy[k] = word()
        rows.append(" ".join(copy))
    rows += [" ".join([word() for _ in range(rnd.randint(30, 90))] + passage) for _ in range(90)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert Counter(tuple(r) for r in near.near_classes(docs).collect()) == classes_by_force(list(enumerate(rows)))


@pytest.mark.parametrize("meeting", [near.MEETING, 700])
def test_near_large_buckets_of_unlike_texts(spark, monkeypatch, meeting):
    """Texts put together from the same paragraphs: their buckets are large, and a few pairs in them are alike. Blocks hold all of them, or four."""
    monkeypatch.setattr(near, "MEETING", meeting)
    rnd = random.Random(21)
    parts = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(9)) for _ in range(24)]
    rows = [(k, " ".join(parts[p] for p in sorted(rnd.sample(range(24), 19)))) for k in range(70)]
    want = classes_by_force(rows)
    assert 5 < sum(r[2] > 1 for r in want) < 65
    assert Counter(tuple(r) for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_near_rows_of_one_id(spark):
    """Rows that share a doc_id, or have none, with different texts that each have a near copy."""
    rnd = random.Random(10)
    rows = []
    for k in range(6):
        base = [rnd.choice("abcdefghij") + str(rnd.randint(0, 10**6)) for _ in range(120)]
        rows += [(None if k > 2 else 1, " ".join(base)), (10 + k if k < 5 else None, " ".join([*base[:60], "other", *base[61:]]))]
    want = classes_by_force(rows)
    assert all(r[2] == 2 for r in want)
    assert Counter(tuple(r) for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()) == want


def test_near_group_of_thousands(spark):
    """Each copy has its own word changed; all are one class, beside texts of their own."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(90)]
    rows = [(k, " ".join([*base[: k % 90], word(), *base[k % 90 + 1 :]])) for k in range(5000)]
    rows += [(k, " ".join(word() for _ in range(40))) for k in range(5000, 5200)]
    found = Counter(r.class_size for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect())
    assert found == {5000: 5000, 1: 200}


def test_near_long_repetitions():
    """Counts beyond 16 bits keep their ratio: 70,000 repetitions are half of 140,000, and nearly 60,000."""
    vectors = []
    for n in (70_000, 140_000, 60_000):
        rows = pa.RecordBatch.from_arrays([pa.array([b"node"]), pa.array(["of " * n])], ["node", "text"])
        vectors.append(next(near._vectors([rows])).column("vector")[0].as_py())
    found = near.cell_links([b"a", b"b", b"c"], np.full(3, near.BOTH), vectors, np.ones(near.CELLS, np.float32))
    assert [set(x) for x in found] == [{b"a", b"c"}]


def test_weighted_samples_agree_as_often_as_weights_overlap():
    """The chance that two rows share a sample is their weighted Jaccard similarity."""
    rnd = np.random.default_rng(4)
    hashes = rnd.integers(0, 1 << 63, 60, dtype=np.uint64)
    a, b = rnd.choice([0.5, 1.0, 2.0], 60), rnd.choice([0.5, 1.0, 2.0], 60)
    rows, starts = np.repeat([0, 1], 60), np.array([0, 60])
    same = [len(set(near.samples(rows, np.tile(hashes, 2), np.concatenate([a, b]), k, starts).tolist())) == 1 for k in range(near.BANDS * near.ROWS)]
    assert np.mean(same) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.12)


def test_stages(spark, docs, nothing, texts):
    items = spark.createDataFrame([(1, texts[13])], "item_id long, text string")
    rows = [tuple(r) for r in docs.collect()]
    unique = keeping.without_exact_copies(docs)
    assert unique.columns == docs.columns and sorted(r.text or "" for r in unique.collect()) == sorted({r[1] or "" for r in rows})
    by_class = {r.doc_id: r.class_id for r in near.near_classes(docs).collect()}
    kept = keeping.without_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in by_class.items() if i == k}
    clean = keeping.without_contaminated(docs, items)
    w = words(texts[13])
    hit = {r[0] for r in rows if brute_hits(r[1], [(1, w[k : k + 10]) for k in range(len(w) - 9)])[4]}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == hit and len(hit) >= 2
    for f in (keeping.without_exact_copies, keeping.without_near_copies, lambda d: keeping.without_contaminated(d, items)):
        assert f(nothing).count() == 0


def test_stages_judge_rows_of_one_id_by_their_own_text(spark):
    """Rows that share a doc_id: one of two near copies stays, and only the row with the leak goes."""
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base, leak, other = ([word() for _ in range(80)] for _ in range(3))
    texts = [" ".join(base), " ".join([*base[:40], word(), *base[41:]]), " ".join(leak), " ".join(other)]
    docs = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")
    near_kept = {r.text for r in keeping.without_near_copies(docs).collect()}
    assert len(near_kept) == 3 and near_kept >= set(texts[2:])
    items = spark.createDataFrame([(1, " ".join(leak[10:30]))], "item_id long, text string")
    assert {r.text for r in keeping.without_contaminated(docs, items).collect()} == {*texts[:2], texts[3]}
