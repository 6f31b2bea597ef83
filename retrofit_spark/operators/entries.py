"""Entries of one property over time: first, latest, as of a year, counts and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookups import UNKNOWN
from .staging import staged


def up_to_year(df: DataFrame, year: int | str | None, date: str = "INSPECTION_DATE", up_to: bool = True) -> DataFrame:
    """Rows of a year, or until its end; as a range of dates, which reaches a Parquet scan. Null dates don't pass. None or "all": every row."""
    if year in (None, "all"):
        return df
    within = F.col(date) < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))
    return df.where(within if up_to else within & (F.col(date) >= F.make_date(F.lit(year), F.lit(1), F.lit(1))))


def has_key(key: str, sentinel: str = UNKNOWN) -> Column:
    """Whether a row has a key: neither null nor the sentinel that cleaning puts in its place."""
    return F.col(key).isNotNull() & (F.col(key).cast("string") != sentinel)


def pick_entry(df: DataFrame, key: str, selection: str, date: str = "INSPECTION_DATE", tie: str = "BUILDING_REFERENCE_NUMBER", null_key: str = "collapse", sentinel: str = UNKNOWN) -> DataFrame:
    """The first or latest row of each key. A null date comes after all others. Rows without a key are one key ("collapse"), or all stay ("keep").

    The rows without a key may be many, so they never enter the window: their one row is found by an aggregate.
    """
    if selection not in ("first entry", "latest entry"):
        raise ValueError(f"selection {selection!r}: choose 'first entry' or 'latest entry'")
    none = ~has_key(key, sentinel)
    latest = selection == "latest entry"
    order = [F.col(date).desc_nulls_first(), F.col(tie).desc_nulls_first()] if latest else [F.col(date).asc_nulls_last(), F.col(tie).asc_nulls_first()]
    named = df.where(~none).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
    rest = df.where(none)
    if null_key == "collapse":
        rest = rest.orderBy(*order).limit(1)
    return named.unionByName(rest)


def filter_by_year(df: DataFrame, key: str, year: int | str | None, up_to: bool = True, selection: str | None = None, **columns) -> DataFrame:
    dated = up_to_year(df, year, columns.get("date", "INSPECTION_DATE"), up_to)
    return dated if selection is None else pick_entry(dated, key, selection, **columns)


#: The count from which all counts are alike.
MANY = 5


def capped_count(n: Column) -> Column:
    return F.when(n >= MANY, "5.0+").otherwise(n.cast("string"))


#: Keys whose rows are spread, at most, and the number of rows beyond which a key is one.
HEAVY_KEYS, HEAVY_ROWS = 1000, 1_000_000


def with_entry_counts(df: DataFrame, keys: dict[str, str], heavy: int = HEAVY_ROWS) -> DataFrame:
    """For each new column, the number of rows with the same key: 1 to 4 or "5.0+"; null for a null key.

    Counts are aggregated and joined, not windowed: once over the given rows for each key, and in one pass over the rows for all keys. Only keys of few rows are joined,
    since all others have "5.0+". Rows of keys of more than `heavy` rows (the sentinel among them; at most HEAVY_KEYS keys, the heaviest) and those without a key meet nothing
    in this join and are spread by the partition that they come from, so no task of it has more than its share.
    """
    given, made = df, set()
    for name, key in keys.items():
        source, n = df if key in made else given, F.col("__n")
        counts = source.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
        counts = staged(counts.where((n < MANY) | (n > heavy)))
        few = counts.where(n < MANY).select("__key", F.lit(0).alias("__to"), "__n")
        top = counts.where((n >= MANY) & (n > heavy)).orderBy(n.desc(), "__key").limit(HEAVY_KEYS).select(F.col("__key").alias("__top")).collect()
        alone = F.col(key).isNull()
        if top:
            df = df.join(F.broadcast(df.sparkSession.createDataFrame(top, few.select(F.col("__key").alias("__top")).schema)), F.col(key) == F.col("__top"), "left")
            alone |= F.col("__top").isNotNull()
        df = df.withColumns({"__at": F.when(~alone, F.col(key)), "__from": F.when(alone, F.spark_partition_id()).otherwise(0)})
        df = df.join(few, (F.col("__at") == F.col("__key")) & (F.col("__from") == F.col("__to")), "left")
        df = df.withColumn(name, F.when(F.col(key).isNotNull(), capped_count(F.coalesce(n, F.lit(MANY))))).drop("__top", "__at", "__from", "__key", "__to", "__n")
        made.add(name)
    return df


def first_and_last_state(df: DataFrame, key: str, state: str, date: str = "INSPECTION_DATE", tie: str = "BUILDING_REFERENCE_NUMBER") -> DataFrame:
    """One row per key: the state at its first and at its last date; of equal dates the earliest row counts in both."""
    dated = df.where(F.col(date).isNotNull() & F.col(key).isNotNull())
    return dated.groupBy(key).agg(F.min_by(state, F.struct(date, tie)).alias("AT_FIRST"), F.max_by(state, F.struct(F.col(date), -F.col(tie))).alias("AT_LAST"))


def status_changes(df: DataFrame, key: str = "UPRN", state: str = "HP_INSTALLED", date: str = "INSPECTION_DATE", tie: str = "BUILDING_REFERENCE_NUMBER", min_entries: int = 2, sentinel: str = UNKNOWN) -> DataFrame:
    """First rows of keys with several entries that didn't start with the state, with HP_ADDED: whether the last has it.

    Null keys don't count. The sentinel is one key; its rows may be many, so they are aggregated and never enter the window.
    """
    own = Window.partitionBy(key)
    order = own.orderBy(F.col(date).asc_nulls_last(), F.col(tie))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = df.where(has_key(key, sentinel)).withColumns({"__n": F.count(F.lit(1)).over(own), "__i": F.row_number().over(order), "HP_ADDED": F.last(state).over(whole)})
    named = marked.where((F.col("__n") >= min_entries) & (F.col("__i") == 1) & ~F.col(state)).drop("__n", "__i")
    place = F.struct(F.col(date).isNull(), date, tie)
    rest = df.where(F.col(key).isNotNull() & ~has_key(key, sentinel))
    rest = rest.agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*df.columns), place).alias("first"), F.max_by(state, place).alias("HP_ADDED"))
    return named.unionByName(rest.where(F.col("n") >= min_entries).select("first.*", "HP_ADDED").where(~F.col(state)))
