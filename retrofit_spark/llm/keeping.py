"""Rows of a document table that an operator's decision keeps, with all their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import hit_rows
from .exact import exact_dedup
from .near import near_rows


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id (null equals null) is among ids (kept_id)."""
    return docs.join(ids.hint("merge"), docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")


def without_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each text: that with the largest doc_id; of rows that repeat doc_id and text, any one."""
    found = exact_dedup(docs)
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    rows = docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["kept_id"]) & (sha == kept["text_sha256"]), "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("kept_id"))
    if repeated.isEmpty():
        return rows
    again = _only(rows, repeated).dropDuplicates(["doc_id", "text"])
    return rows.join(repeated, rows["doc_id"].eqNullSafe(repeated["kept_id"]), "left_anti").unionByName(again)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The first row of each near-duplicate class: that with the least doc_id, of rows that share it the one with the least hash of its text. Rows that repeat doc_id and text stay or go together."""
    found = near_rows(docs)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("key").eqNullSafe(F.col("class_key"))).select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    return docs.join(first.hint("merge"), docs["doc_id"].eqNullSafe(first["kept_id"]) & (F.xxhash64(docs["text"]) == first["kept_key"]), "left_semi")


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows that hold no window of an item; of rows that share a doc_id each is judged by its own text."""
    hit = hit_rows(docs, items).where("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key")).distinct()
    return docs.join(hit.hint("merge"), docs["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(docs["text"]) == hit["hit_key"]), "left_anti")
