import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from retrofit_spark.llm import fim

from .conftest import SCHEMA, rows_of


def by_force(i, text, fim_percent=100, spm_percent=50, seed="7"):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    n, h = len(lines), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_percent:
        return i, n, "plain", None, None, t
    if h4 % 100 < spm_percent:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def lined(spark, texts):
    rnd = random.Random(3)
    own = ["\n", "\n\n\n", "a\n\nb", "a\r\nb\r\n", "<P> x", "a <M>\nb", "<\nS>\nx<S", "P>\n<", "é\n日本\n\U0001f600\n" * 40, "x" * 2_500_000 + "\ny\n", "line\n" * 700_000]
    own += ["\n".join("wörd " * rnd.randint(0, 9) for _ in range(rnd.randint(1, 300))) for _ in range(40)]
    rows = rows_of([*texts, *own])
    return spark.createDataFrame([*rows, rows[7], rows[-1], (None, "a\nb\nc", *rows[0][2:]), (-5, "a\nb", *rows[0][2:])], SCHEMA).repartition(3)


@pytest.mark.parametrize("options", [{}, {"fim_percent": 30, "spm_percent": 0, "seed": "x"}, {"fim_percent": 0}, {"spm_percent": 100}])
def test_fill_in_middle(lined, options):
    got = Counter(tuple(r) for r in fim.fill_in_middle(lined, **options).collect())
    assert got == Counter(by_force(r.doc_id, r.text, **options) for r in lined.collect())


def test_restored(lined):
    want = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in lined.collect())
    got = fim.digest(fim.fill_in_middle(lined))
    assert Counter((r.doc_id, r.restored_sha256) for r in got.collect()) == want
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_empty_table(nothing):
    assert fim.digest(fim.fill_in_middle(nothing)).count() == 0


def test_own_sentinels(spark):
    docs = spark.createDataFrame([(k, f"one {k}\ntwo <P>\nthree\n") for k in range(50)], "doc_id long, text string")
    words = {"prefix": "\x01pre", "suffix": "\x01suf", "middle": "\x01mid"}
    made = fim.fill_in_middle(docs, **words)
    assert made.where("form = 'plain'").count() == 0
    back = made.select("doc_id", fim.restored(made["output"], made["form"], **words).alias("text"))
    assert sorted(back.collect()) == sorted(docs.collect())
    for bad in ({"prefix": "<S>"}, {"prefix": ""}, {"prefix": "<S>x"}, {"prefix": "<a<b"}):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, **bad)


def test_skip_list_takes_few_steps():
    """Every rank of a long text, and lanes that get shorter by about the share that is promoted."""
    data = np.frombuffer(("é" * 3 + "\n").encode() * 5000 + b"\n" * 10, np.uint8)
    lines = fim.SkipList(data, np.array([0, 7 * 5000, 7 * 5000, len(data)]))
    assert lines.lines.tolist() == [5000, 0, 10] and 4 <= len(lines.lanes) <= 12
    sizes = [lane[0].shape[1] for lane in lines.lanes]
    assert all(b < a / 2 for a, b in zip(sizes[:4], sizes[1:5], strict=True))
    for rank in (0, 1, 2, 17, 999, 4096, 4999, 5000):
        chars, size = lines.descend(np.array([rank, 0, min(rank, 10)]))
        assert chars.tolist() == [4 * rank, 0, min(rank, 10)] and size.tolist() == [7 * rank, 0, min(rank, 10)]
