import os

import pytest

import corpus_pipeline
from retrofit_spark.llm import registry
from retrofit_spark.llm.units import load, tokenizer_path

from .conftest import SCHEMA, rows_of

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "benchmark decontamination", "BPE encoding and decoding"]
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES if q.startswith("op")) == list(range(1, 14)) and "pipeline" in registry.QUERIES


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_run(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        seen.append((name, after.count()))
        docs = after
    assert all(a[1] >= b[1] > 0 for a, b in zip(seen, seen[1:], strict=False)), seen
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == seen[-1][1] and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_run_on_odd_tables(spark, tmp_path, texts, kind):
    """Null and repeated ids, rows that repeat, null, empty and very long texts, clashing columns; and no rows at all."""
    rows = rows_of([*texts, "y" * 3_000_000 + " z", "hello world"]) if kind == "odd" else []
    if rows:
        rows += [rows[6], rows[30], (None, *rows[31][1:]), (None, "words without an id " * 30, *rows[0][2:]), (rows[32][0], "other words of one id " * 20, *rows[0][2:])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == bool(rows) and {r.doc_id for r in out} <= {r[0] for r in rows}
    tokenizer = load(tokenizer_path("byte_bpe_50k.json"))
    counts = {}
    for row in rows:
        counts.setdefault(row[0], set()).add(len(tokenizer.encode(row[1] or "", add_special_tokens=False).ids))
    assert all(r.n_tokens in counts[r.doc_id] for r in out)
