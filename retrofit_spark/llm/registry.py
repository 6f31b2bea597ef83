"""Queries of this package and their oracle SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe, counts, decontaminate, exact, fim, lm, mining, near, packing, quality, repeats, secrets, store


def documents_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.find_secrets(documents_of(spark, sf_dir)))


def op2_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(documents_of(spark, sf_dir))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(documents_of(spark, sf_dir))


def op5_token_store(spark, sf_dir):
    return store.stored_summary(documents_of(spark, sf_dir))


def op6_suffix_dedup(spark, sf_dir):
    return repeats.remove_repeats(documents_of(spark, sf_dir))


def op7_token_counts(spark, sf_dir):
    return counts.count_tokens(documents_of(spark, sf_dir))


def op8_lm_score(spark, sf_dir):
    return lm.score_documents(documents_of(spark, sf_dir))


def op9_quality(spark, sf_dir):
    return quality.classify(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_near_dedup(spark, sf_dir):
    return near.near_classes(documents_of(spark, sf_dir))


def op11_hard_negatives(spark, sf_dir):
    return mining.mine(mining.of_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_fill_in_middle(spark, sf_dir):
    return fim.digest(fim.fill_in_middle(documents_of(spark, sf_dir)))


def op13_best_fit_packing(spark, sf_dir):
    return packing.digest(packing.pack(documents_of(spark, sf_dir)))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_token_store": op5_token_store,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_lm_score": op8_lm_score,
    "op9_quality": op9_quality,
    "op10_near_dedup": op10_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_best_fit_packing": op13_best_fit_packing,
    "pipeline": pipeline,
}
ORACLES = {
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op3_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT grams.r, grams.s, grams.n, item_id FROM grams JOIN windows USING (n, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = b.label AS same, b.r, b.vec_id AS id, list_inner_product(a.e::DOUBLE[], b.e::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op12_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l
  FROM documents),
k AS (
  SELECT *, len(l) AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(l[1:least(x, y)], '') AS a, array_to_string(l[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(l[greatest(x, y) + 1:n], '') AS z
  FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""",
}
