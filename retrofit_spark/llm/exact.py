"""Exact dedup by distributed MSD radix partitioning.

Documents are split by their length and then by successive runs of bytes, most significant first.
Each round groups the undecided documents by (group so far, next bytes): a document alone in its
group is done, a group whose texts have ended holds equal texts, and the rest goes on to the next
bytes. Runs grow sixteenfold from 32 bytes on, without an end, so two equal texts of n bytes take about log16(n/32)
rounds (six for 20 MB), of which each writes what is left of them once. A key is a part of one text, cut off
from it before both are shuffled, so a row is never larger than its text. No digest takes part in deciding equality.

Group sizes are aggregated before they are shuffled, and the rows return to their group by a
sort-merge join whose skewed keys Spark splits, so a group of a third of all rows isn't one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, documents

FIRST_BYTES, GROWTH = 32, 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id (the largest doc_id of its group), group_size, kept, text_sha256.

    Null text counts as empty. Repeated rows stay rows of their own: of rows with the same text and the
    same largest doc_id exactly one is kept. A null doc_id is smaller than any other. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rest = documents(docs, id_col, text_col).select(
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("rest"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"),
        F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("group"),
    )
    done, step, depth = [], 0, FIRST_BYTES
    while True:
        keyed = rest.select("doc_id", "text_sha256", "group", F.substring("rest", 1, depth).alias("digit"), F.substring("rest", depth + 1, 1 << 30).alias("tail"))
        groups = keyed.groupBy("group", "digit").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
        groups = scratch.write(groups.where("group_size > 1").withColumn("next_group", F.monotonically_increasing_id()), f"groups{step}")
        joined = keyed.join(groups.hint("merge"), ["group", "digit"], "left")  # by one plan at every size
        state = scratch.write(
            joined.select(
                "doc_id", "text_sha256", "group_size", "keep_id", F.col("next_group").alias("group"),
                F.when(F.col("next_group").isNotNull(), F.col("tail")).alias("rest"),
            ),
            f"state{step}",
        )
        ended = (F.col("group").isNull()) | (F.octet_length("rest") == 0)
        done.append(state.where(ended).select("doc_id", "group", F.lit(step).alias("step"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), "text_sha256"))
        rest = state.where(~ended).select("doc_id", "rest", "text_sha256", "group")
        scratch.drop(f"groups{step}")
        step, depth = step + 1, min(depth * GROWTH, 1 << 30)
        if rest.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return _one_kept(found)


def _one_kept(found: DataFrame) -> DataFrame:
    """kept, with one row of each group even where rows repeat the largest doc_id: those rows are counted, and dealt out again with one of them kept."""
    cols, top = ["doc_id", "keep_id", "group_size"], F.col("doc_id").eqNullSafe(F.col("keep_id"))
    decided = found.where(F.col("group").isNull() | ~top).select(*cols, F.col("group").isNull().alias("kept"), "text_sha256")
    winners = found.where(F.col("group").isNotNull() & top).groupBy("step", "group", *cols, "text_sha256").agg(F.count(F.lit(1)).cast("int").alias("n"))
    winners = winners.select(*cols, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"), "text_sha256")
    return decided.unionByName(winners.select(*cols, (F.col("nth") == 1).alias("kept"), "text_sha256"))
