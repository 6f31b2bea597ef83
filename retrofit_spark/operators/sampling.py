"""Samples and splits. Order is by a seeded MD5 of a key: the same on any cluster, and sayable in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def seeded(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def complete_groups(df: DataFrame, key: str, least: int, seed: int = 42, prefix: int = 3) -> DataFrame:
    """All rows of randomly ordered groups until `least` rows are reached, the group that crosses it included.

    The running sum over groups has two levels: buckets by the first hex digits of the hash, 16 ** prefix of them, and
    groups within a bucket. So there is no window over all groups.
    """
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", seeded(F.col(key), seed)).withColumn("__b", F.substring("__h", 1, prefix))
    buckets = sizes.groupBy("__b").agg(F.sum("__n").alias("__sum"))
    earlier = F.coalesce(F.sum("__sum").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.broadcast(buckets.select("__b", earlier.alias("__start")))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__b").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = sizes.join(start, "__b").withColumn("__before", F.col("__start") + inside).where(F.col("__before") < least)
    return df.join(chosen.select(key), key, "left_semi")


def sample_with_replacement(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """About n rows, drawn with replacement: the number varies as the draws do. For exactly n, exact_sample()."""
    total = df.count()
    return df.sample(withReplacement=True, fraction=n / max(total, 1), seed=seed)


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows, drawn with replacement; none from an empty table. The same on any cluster: draw i takes the row whose place, by the seeded hash of its key, is a hash of i.

    Rows get their places in two levels, draws are made where they are needed and added up by place, and the two are joined. Keys must be unique.
    """
    placed = _ranked(df, seeded(F.col(key), seed), key).withColumn("__n", F.col("__n").cast("long"))
    total = df.count()
    if not total:
        return df
    draw = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 14), 16, 10).cast("long"), F.lit(total)) + 1
    draws = df.sparkSession.range(n).groupBy(draw.alias("__place")).agg(F.count(F.lit(1)).alias("__times"))
    taken = placed.join(draws, F.col("__i") == F.col("__place"))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).drop("__i", "__n", "__place", "__times", "__copy")


def _ranked(df: DataFrame, order: Column, key: str, stratum: Column | None = None, prefix: int = 3, reach: int | None = None) -> DataFrame:
    """Adds __i, the row's place in its stratum by hexadecimal `order` and then `key`, and __n, the stratum's rows.

    Places have two levels: buckets by the first digits of `order`, and rows within a bucket, so that no window holds a
    stratum. With `reach`, buckets that begin beyond it are left out.
    """
    df = df.withColumns({"__o": order, "__s": F.lit(1) if stratum is None else stratum}).withColumn("__b", F.substring("__o", 1, prefix))
    buckets = df.groupBy(F.col("__s").alias("__t"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__m"))
    own = Window.partitionBy("__t")  # at most 16 ** prefix rows
    start = F.coalesce(F.sum("__m").over(own.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select("__t", "__c", start.alias("__start"), F.sum("__m").over(own).alias("__n"))
    if reach is not None:
        buckets = buckets.where(F.col("__start") < reach)
    placed = df.join(buckets, F.col("__s").eqNullSafe(F.col("__t")) & (F.col("__b") == F.col("__c")))
    inside = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__o", key))
    return placed.withColumn("__i", F.col("__start") + inside).drop("__o", "__s", "__b", "__t", "__c", "__start")


def lowest(df: DataFrame, order: Column, n: int, key: str) -> DataFrame:
    """The n rows of least hexadecimal `order`, ties by `key`: only the bucket that crosses n is cut."""
    return _ranked(df, order, key, reach=n).where(F.col("__i") <= n).drop("__i", "__n")


def balance(df: DataFrame, target: str, key: str, false_ratio: float = 0.8, binary: bool = True, seed: int = 42) -> DataFrame:
    """All rows with the target and so many without that these make up `false_ratio`, the least by seeded hash."""
    c = F.col(target)
    yes, no = (c, ~c) if binary else (c > 0, c == 0)
    n = int(df.where(yes).count() * (false_ratio / (1 - false_ratio)))
    return df.where(yes).unionByName(lowest(df.where(no), seeded(F.col(key), seed), n, key))


def split(df: DataFrame, key: str, test_share: float = 0.1, stratify: str | None = None, seed: int = 42, name: str = "training set") -> DataFrame:
    """A flag per row: false for the share of rows, in each stratum, that is least by seeded hash.

    Counts of the hash's first digits tell on which side a row is, but for the one bucket of a stratum that the share ends in. Only this bucket is ranked, so rows
    aren't shuffled.
    """
    made = df.withColumns({"__o": seeded(F.col(key), seed), "__s": F.col(stratify) if stratify else F.lit(1)}).withColumn("__b", F.substring("__o", 1, 3))
    buckets = made.groupBy(F.col("__s").alias("__t"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__m"))
    own = Window.partitionBy("__t")  # at most 16 ** 3 rows
    upto = F.sum("__m").over(own.orderBy("__c").rowsBetween(Window.unboundedPreceding, 0))
    buckets = buckets.withColumns({"__upto": upto, "__last": F.ceil(F.sum("__m").over(own) * test_share)})
    ending = F.min(F.when((F.col("__upto") > F.col("__last")) & F.col("__c").isNotNull(), F.struct("__c", (F.col("__last") - F.col("__upto") + F.col("__m")).alias("left"))))
    ends = buckets.groupBy("__t").agg(ending.alias("__end"))  # null where all rows are test rows
    few = not stratify or isinstance(df.schema[stratify].dataType, BooleanType)
    placed = made.join(F.broadcast(ends) if few else ends, F.col("__s").eqNullSafe(F.col("__t")))
    cut = F.col("__end")["__c"]
    sure = placed.where(F.col("__b").isNotNull() & ~F.col("__b").eqNullSafe(cut)).withColumn(name, F.coalesce(F.col("__b") > cut, F.lit(False)))
    ranked = placed.where(F.col("__b") == cut).withColumn(name, F.row_number().over(Window.partitionBy("__s").orderBy("__o", key)) > F.col("__end")["left"])
    return sure.unionByName(ranked).drop("__o", "__s", "__b", "__t", "__end")


def split_by_hash(df: DataFrame, key: str, test_share: float = 0.1, seed: int = 42, name: str = "training set") -> DataFrame:
    """Like split, without a shuffle: a row is a test row by its own hash, so shares hold on average."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) >= int(test_share * 1_000_000))
