"""Aggregates by hexagonal grid cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import heat_pump_share_class, mean_rating_class, rating_number
from .areas import category_shares_wide, most_frequent

KM_PER_DEGREE_LAT, KM_PER_DEGREE_LON = 110.57, 111.32
MIDDLE_LATITUDE = 54


def cell(latitude: Column, longitude: Column, size_km: float = 7.5) -> Column:
    """The hexagon of a place, as "q:r" in axial coordinates; `size_km` is a hexagon's side."""
    x = longitude * F.lit(KM_PER_DEGREE_LON) * F.cos(F.radians(F.lit(MIDDLE_LATITUDE)))
    y = latitude * F.lit(KM_PER_DEGREE_LAT)
    q, r = (F.lit(math.sqrt(3) / 3) * x - y / 3) / F.lit(size_km), (F.lit(2.0) / 3 * y) / F.lit(size_km)
    s = -q - r
    rq, rr, rs = (F.floor(v + 0.5) for v in (q, r, s))
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    by_q = (dq > dr) & (dq > ds)
    out_q = F.when(by_q, -rr - rs).otherwise(rq)
    out_r = F.when(~by_q & (dr > ds), -rq - rs).otherwise(rr)
    return F.concat_ws(":", out_q.cast("long").cast("string"), out_r.cast("long").cast("string"))


def with_cell(df: DataFrame, latitude: str = "LATITUDE", longitude: str = "LONGITUDE", size_km: float = 7.5, name: str = "hex_id") -> DataFrame:
    return df.withColumn(name, cell(F.col(latitude), F.col(longitude), size_km))


def cell_shares(df: DataFrame, feature: str, key: str = "hex_id", values: dict | None = None) -> DataFrame:
    return category_shares_wide(df, key, [feature], values)


def _mean_rating(rating: str) -> Column:
    """Mean rating number over the cell's non-null ratings; unknown ones weigh nothing but count."""
    return F.try_divide(F.sum(F.coalesce(rating_number(F.col(rating)), F.lit(0.0))), F.count(rating))


def cell_features(df: DataFrame, key: str = "hex_id", rating: str = "CURRENT_ENERGY_RATING", installed: str = "HP_INSTALLED", extra: str | None = None, year_stamp: str | None = None, means: tuple[str, ...] = ("CO2_EMISSIONS_CURRENT", "HEATING_COST_CURRENT"), values: dict | None = None) -> DataFrame:
    """One row per cell: mean rating and its class, density, commonest rating, heat-pump share and its class, means of what columns there are."""
    here = {c.upper(): c for c in df.columns}
    share = F.avg(F.col(installed).cast("int")) * 100
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(rating).alias("density"), _mean_rating(rating).alias("HEX_RATING"), F.mode(rating, True).alias("MOST_FREQUENT_CURRENT_ENERGY_RATING"),
        share.alias("HP_PERC"), F.mode(installed, True).alias("MOST_FREQUENT_HP_INSTALLED"), *(F.avg(here[m]).alias(m) for m in means if m in here),
    )
    out = out.withColumns({"EPC_CAT": mean_rating_class(F.col("HEX_RATING")), "HP_CAT": heat_pump_share_class(F.col("HP_PERC"))})
    if year_stamp is not None:
        out = out.withColumn("YEAR_STAMP", F.lit(year_stamp))
    return out.join(cell_shares(df, extra, key, values), key) if extra else out


def cell_mode(df: DataFrame, feature: str = "LOCAL_AUTHORITY_LABEL", key: str = "hex_id") -> DataFrame:
    return most_frequent(df, key, feature)


def cell_uptake(df: DataFrame, key: str = "hex_id", installed: str = "HP_INSTALLED") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg((F.avg(F.col(installed).cast("int")) * 100).alias("heat_pump_perc"), F.count(installed).alias("density"))


def cell_ratings(df: DataFrame, key: str = "hex_id", rating: str = "CURRENT_ENERGY_RATING", ratings: str = "ABCDEFG") -> DataFrame:
    """Shares of ratings by cell, their mean and its class."""
    shares = [F.try_divide(F.count_if(F.col(rating) == v), F.count(rating)).alias(v) for v in ratings]
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(rating).alias("total"), _mean_rating(rating).alias("HEX_RATING"), *shares)
    return out.withColumn("EPC_CAT", mean_rating_class(F.col("HEX_RATING")))
