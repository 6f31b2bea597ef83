"""Aggregates by postcode level or any other area key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType, StructField, StructType

from ..functions.encode import categories, one_hot
from .entries import up_to_year


def group_size(df: DataFrame, key: str, of: str | None = None, name: str = "n") -> DataFrame:
    """Rows of each group, or its non-null values of a column; the null group doesn't count."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(of if of else F.lit(1)).alias(name))


def category_counts(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """key, feature, category, n: all features in one shuffle. Null keys and categories don't count."""
    long = df.where(F.col(key).isNotNull()).select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("string").alias("category")) for f in features))).alias("x")).select(key, "x.feature", "x.category")
    return long.where("category IS NOT NULL").groupBy(key, "feature", "category").agg(F.count(F.lit(1)).alias("n"))


def category_shares(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """The share of each category among its feature's non-null values of the group."""
    own = Window.partitionBy(key, "feature")
    return category_counts(df, key, features).withColumn("share", F.col("n") / F.sum("n").over(own))


def category_shares_wide(df: DataFrame, key: str, features: list[str], values: dict[str, list] | None = None) -> DataFrame:
    """One row per group: a column "feature: category" with each share, MOST_FREQUENT_<feature>, and <key>_TOTAL, the first feature's non-null values. Ties go to the first category in order."""
    values = values or categories(df, features)
    c = lambda f: F.col(f"`{f}`")
    shares = [F.try_divide(F.count_if(c(f).cast("string") == v), F.count(c(f))).alias(f"{f}: {v}") for f in features for v in values[f]]
    modes = [F.mode(c(f), True).alias(f"MOST_FREQUENT_{f}") for f in features]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(c(features[0])).alias(f"{key}_TOTAL"), *shares, *modes)


def most_frequent(df: DataFrame, key: str, feature: str) -> DataFrame:
    """Each group's commonest category, the first in order of equal ones. Counted in two steps, so no group is held whole."""
    top = F.min_by("category", F.struct(-F.col("n"), F.col("category")))
    return category_counts(df, key, [feature]).groupBy(key).agg(top.alias(f"MOST_FREQUENT_{feature}"))


def value_count(df: DataFrame, key: str, feature: str, value=True, name: str | None = None) -> DataFrame:
    """How often each group has a value; 0 where it only has others; groups without any value are left out."""
    name = name or f"{feature}: {value}"
    counted = df.where(F.col(key).isNotNull() & F.col(feature).isNotNull())
    return counted.groupBy(key).agg(F.count_if(F.col(feature) == F.lit(value)).alias(name))


#: Rows of a group beyond which its medians are selected by counts, and the buckets of a round of that.
HEAVY, BUCKETS = 1_000_000, 1024


def medians(df: DataFrame, key: str, features: list[str] | None = None, exact: bool = True, heavy: int = HEAVY) -> DataFrame:
    """Median of every numeric column by group; `exact=False` takes the approximate percentile.

    A group of more than `heavy` rows is held by no aggregate: its medians are selected by counts (heavy_medians()).
    """
    features = features or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != key]
    value = (lambda f: F.median(f"`{f}`")) if exact else (lambda f: F.percentile_approx(f"`{f}`", 0.5, 10_000).cast("double"))
    keyed = df.where(F.col(key).isNotNull())
    if not exact or not features:
        return keyed.groupBy(key).agg(*(value(f).alias(f) for f in features))
    many = keyed.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > heavy).select("__key").collect()  # fewer than rows / heavy
    if not many:
        return keyed.groupBy(key).agg(*(value(f).alias(f) for f in features))
    large = F.broadcast(df.sparkSession.createDataFrame(many, StructType([StructField("__key", df.schema[key].dataType)])))
    light = keyed.join(large, F.col(key) == F.col("__key"), "left_anti").groupBy(key).agg(*(value(f).alias(f) for f in features))
    return light.unionByName(heavy_medians(keyed.join(large, F.col(key) == F.col("__key"), "left_semi"), key, features, heavy))


def heavy_medians(df: DataFrame, key: str, features: list[str], small: int = HEAVY) -> DataFrame:
    """Exact medians of few large groups by rounds of counts.

    A round cuts each group's and column's interval of values, first from least to largest, into BUCKETS, counts them in one aggregate, and keeps the
    bucket that holds the middle. The two middle values are known when they lie in two buckets, or in one whose values are equal; a bucket
    of `small` values or fewer is left to a plain median of its middle.
    """
    value = F.array(*(F.struct(F.lit(k).alias("f"), F.col(f"`{f}`").cast("double").alias("v")) for k, f in enumerate(features)))
    long = df.select(F.col(key).alias("g"), F.explode(value).alias("x")).select("g", "x.f", "x.v").where(F.col("v").isNotNull())
    open_ = [(r.g, r.f, r.lo, r.hi, (r.n - 1) // 2, r.n // 2) for r in long.groupBy("g", "f").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).collect()]
    schema = StructType([StructField("g", df.schema[key].dataType)]).add("f", "integer").add("lo", "double").add("hi", "double").add("first", "long").add("second", "long")
    found = {}
    while open_:  # a row for each large group and column
        state = F.broadcast(df.sparkSession.createDataFrame(open_, schema))
        inside = long.join(state, ["g", "f"]).where(F.col("v").between(F.col("lo"), F.col("hi")))
        place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS))).otherwise(0)
        counts = inside.groupBy("g", "f", "first", "second", place.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "f").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        middle = counts.withColumn("before", before).where((F.col("before") <= F.col("second")) & (F.col("before") + F.col("n") > F.col("first"))).orderBy("g", "f", "bucket")
        held: dict = {}
        for r in middle.collect():  # one or two buckets each
            held.setdefault((r.g, r.f), []).append(r)
        open_, last = [], []
        for at, rows in held.items():
            low, high = rows[0], rows[-1]
            if len(rows) > 1 or low.lo == low.hi:
                found[at] = (low.hi + high.lo) / 2
            else:
                (last if low.n <= small else open_).append((*at, low.lo, low.hi, low.first - low.before, low.second - low.before))
        if last:
            own = F.broadcast(df.sparkSession.createDataFrame(last, schema))
            values = F.sort_array(F.collect_list("v"))  # at most `small`
            few = long.join(own, ["g", "f"]).where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("g", "f").agg(values.alias("v"), F.first("first").alias("i"), F.first("second").alias("j"))
            picked = few.select("g", "f", ((F.get("v", F.col("i").cast("int")) + F.get("v", F.col("j").cast("int"))) / 2).alias("m"))
            found |= {(r.g, r.f): r.m for r in picked.collect()}
    groups = [r.g for r in df.select(F.col(key).alias("g")).distinct().collect()]
    out = StructType([StructField(key, df.schema[key].dataType)] + [StructField(f, DoubleType()) for f in features])
    return df.sparkSession.createDataFrame([(g, *(found.get((g, k)) for k in range(len(features)))) for g in groups], out)


def area_features(df: DataFrame, key: str, ordinal: list[str] = (), drop: list[str] = (), values: dict[str, list] | None = None) -> DataFrame:
    """One row per area: medians of numbers, shares of categories and their one-hot most frequent one. Ordinal features are left out."""
    df = df.drop(*drop)
    skip = {key, *ordinal, *(c for c in df.columns if c.upper().startswith("POSTCODE"))}
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]
    texts = [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType) and f.name not in skip]
    values = values or categories(df, texts)
    wide = category_shares_wide(df, key, texts, values)
    hot = one_hot(wide, [f"MOST_FREQUENT_{f}" for f in texts], {f"MOST_FREQUENT_{f}": values[f] for f in texts})
    return medians(df, key, numbers).join(hot, key)


def growth(df: DataFrame, area: str, source_year: int, target_year: int, normalise_by: str = "total", key: str = "UPRN", installed: str = "HP_INSTALLED", date: str = "INSPECTION_DATE", tie: str = "BUILDING_REFERENCE_NUMBER") -> DataFrame:
    """Coverage with heat pumps of each area at two years, and its growth.

    One window pass over properties finds, for each, its latest row by the source year, by the target year and
    of all (a null date is the latest); one aggregate by area counts them. Null keys are no property. The
    sentinel key is one; its rows may be many, so its three latest rows are found by an aggregate and never enter the window. Areas absent from any of the three
    snapshots are left out. The base is all properties ("total"), those of the target year ("target") or all heat pumps ("total HPs").
    """
    if normalise_by not in ("total", "target", "total HPs"):
        raise ValueError(f"base {normalise_by!r}: choose 'total', 'target' or 'total HPs'")
    from .entries import has_key

    own = Window.partitionBy(key)
    d, t = F.col(date), F.col(tie)

    def latest(year):
        inside = F.coalesce(d < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1)), F.lit(False))
        return inside & F.coalesce(F.max(F.when(inside, F.struct(d, t))).over(own) == F.struct(d, t), F.lit(False))

    rank = F.struct(d.isNull(), F.coalesce(d, F.lit("1900-01-01").cast("date")), t)
    flags = df.where(has_key(key)).select(area, installed, latest(source_year).alias("s"), latest(target_year).alias("t"), (F.max(rank).over(own) == rank).alias("a"))
    rest = df.where(F.col(key).isNotNull() & ~has_key(key)).select(area, installed, d.alias("d"), t.alias("t"), rank.alias("rank"))
    of_year = lambda year: F.when(F.col("d") < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1)), F.struct("d", "t"))
    for k, place in enumerate((of_year(source_year), of_year(target_year), F.col("rank"))):
        row = rest.where(place.isNotNull()).agg(F.max_by(F.struct(area, installed), place).alias("row")).where("row IS NOT NULL")
        flags = flags.unionByName(row.select("row.*", *(F.lit(k == n).alias(f) for n, f in enumerate("sta"))))
    hp = F.col(installed)
    counts = flags.where(F.col(area).isNotNull()).groupBy(area).agg(*(F.count_if(f).alias(f"n_{f}") for f in "sta"), *(F.count_if(F.col(f) & hp).alias(f"hp_{f}") for f in "sta"))
    base = F.col({"total": "n_a", "target": "n_t", "total HPs": "hp_a"}[normalise_by])
    present = counts.where("n_s > 0 AND n_t > 0 AND n_a > 0")
    covered = present.withColumns({"HP_COVERAGE_CURRENT": F.try_divide("hp_s", base), "HP_COVERAGE_FUTURE": F.try_divide("hp_t", base)})
    return covered.select(area, "HP_COVERAGE_CURRENT", "HP_COVERAGE_FUTURE", (F.col("HP_COVERAGE_FUTURE") - F.col("HP_COVERAGE_CURRENT")).alias("GROWTH"))


def area_training_table(df: DataFrame, area: str, source_year: int, target_year: int, drop: list[str] = (), ordinal: list[str] = (), values: dict | None = None, key: str = "UPRN", **columns) -> DataFrame:
    """Features of each area's properties as of the source year with its growth; areas that shrink are left out."""
    from .entries import pick_entry

    date, tie = columns.get("date", "INSPECTION_DATE"), columns.get("tie", "BUILDING_REFERENCE_NUMBER")
    source = pick_entry(up_to_year(df, source_year, date), key, "latest entry", date=date, tie=tie)
    features = area_features(source.drop(key, date, tie), area, ordinal=ordinal, drop=drop, values=values)
    return features.join(growth(df, area, source_year, target_year, key=key, **columns), area).where("GROWTH >= 0")
