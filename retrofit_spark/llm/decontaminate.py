"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Every window of an item (ten consecutive words, or the whole of a shorter item) is a set of words
that must be contained whole. For containment 1 the necessary prefix is one word: the window's
rarest in the corpus. Documents' words are joined on that word alone; the word's place in the
window gives where the window would have to start (positional bound), and whether it fits into the
document (length bound); what remains is verified word by word over a span of the window's size.

One plan serves benchmarks of every size. Words that no window uses are dropped where they are read, by a filter
of fixed size (a bit for each of SLOTS values of the word's hash); what passes by chance is dropped by the
join. Windows and counts stay tables; Spark broadcasts them only if they are below its own bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, documents

WINDOW = 10
#: Bits of the filter of words, a power of two: 1 MB at every size.
SLOTS = 1 << 23

#: Runs of the characters that words don't hold; the lower-casing of A-Z comes first.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, w (its words in order), distinct; items without words have none."""
    own = items.select(items[item_col].alias("item_id"), words(items[text_col]).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return own.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("all", s, window))).alias("w")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words. Repeated rows give a row each. Repeated items with the same item_id count once;
    a null item_id counts as no item in n_items, but its words are hit. Empty tables: no rows, or no hits.
    """
    return hit_rows(docs, items, id_col, text_col, item_col, item_text_col, window).drop("key")


def hit_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of decontaminate(), with key: xxhash64 of the text."""
    scratch = Scratch(docs.sparkSession)
    own = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("words"))
    windows = scratch.write(item_windows(items, item_col, item_text_col, window), "windows")
    numbered = windows.select("item_id", "w", F.posexplode("w").alias("offset", "word"))

    # Rarity: occurrences in the whole corpus of the words that items use, summed before they are shuffled.
    used = word_filter(numbered)
    counts = own.select(F.explode("words").alias("word")).where(passes(used, F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset"))
    prefixed = numbered.join(counts, "word", "left").groupBy("item_id", "w").agg(rarest.alias("rare")).where("rare.n > 0")
    prefixed = scratch.write(prefixed.select("item_id", "w", F.col("rare.word").alias("word"), F.col("rare.offset").alias("offset")), "prefixed")

    # A row for each place of a prefix word, with the words around it, and one at least for each document. The latter
    # has a key of its own that no word equals (words hold no NUL), so that such rows don't meet in one task.
    at = own.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "key", "words", F.posexplode_outer("words").alias("at", "here"))
    is_prefix = F.coalesce(passes(word_filter(prefixed), F.col("here")), F.lit(False))
    first = F.greatest(F.col("at") - (window - 1), F.lit(0))
    rows = at.where(is_prefix | (F.coalesce("at", F.lit(0)) == 0)).select(
        "row", "doc_id", "key", F.size("words").cast("long").alias("n_words"), "at", first.alias("from"),
        F.when(is_prefix, F.col("here")).otherwise(F.concat(F.lit("\0"), F.col("row").cast("string"))).alias("word"),
        F.when(is_prefix, F.slice("words", first + 1, 2 * window - 1)).alias("near"),
    )
    start = F.col("at") - F.col("offset")
    length = F.size("w")
    hit = (start >= 0) & (start + length <= F.col("n_words")) & (F.slice("near", F.greatest(start - F.col("from"), F.lit(0)) + 1, length) == F.col("w"))
    met = rows.join(prefixed, "word", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    by_row = met.groupBy("row", "doc_id", "key", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("hit"), F.struct(start.alias("s"), (start + length).alias("e"))))).alias("spans"),
        F.collect_set(F.when(F.col("hit"), F.col("item_id").cast("string"))).alias("items"),
    )
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), _cover, lambda a: a["n"])
    return by_row.select(
        "doc_id", "key", "n_words", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def word_filter(table: DataFrame) -> DataFrame:
    """One row: an array of SLOTS bits in longs, where the bit of each `word` of the table is set."""
    slot = F.xxhash64("word").bitwiseAND(SLOTS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    taken = table.select(F.shiftright(slot, 6).alias("i"), bit.alias("bits"))
    none = table.sparkSession.range(0, SLOTS // 64, 1, 1).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("bits"))
    cells = taken.unionByName(none).groupBy("i").agg(F.bit_or("bits").alias("bits"))
    return cells.agg(F.array_sort(F.collect_list(F.struct("i", "bits")))["bits"].alias("bits"))


def passes(bits: DataFrame, word: Column) -> Column:
    """Whether the word's bit is set in a word_filter()."""
    slot = F.xxhash64(word).bitwiseAND(SLOTS - 1)
    return F.getbit(F.get(bits.scalar(), F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")) == 1


def _cover(a: Column, span: Column) -> Column:
    """Words covered by spans that come by their start."""
    end = F.greatest(a["end"], span["e"])
    return F.struct((a["n"] + end - F.greatest(a["end"], span["s"])).alias("n"), end.alias("end"))
