"""Joins with dimension tables, by normalised keys. Spark broadcasts a side where its size is small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import postcode


def join_deprivation(df: DataFrame, imd: DataFrame, postcode_col: str = "POSTCODE", imd_postcode: str = "Postcode") -> DataFrame:
    """Inner join on postcodes without blanks, letters as they are; the certificate's postcode comes out without blanks."""
    plain = lambda c: F.regexp_replace(c, " ", "")
    right = imd.withColumn("__pc", plain(F.col(imd_postcode))).drop(imd_postcode)
    return df.withColumn(postcode_col, plain(F.col(postcode_col))).join(right, F.col(postcode_col) == F.col("__pc")).drop("__pc")


def join_coordinates(df: DataFrame, coordinates: DataFrame, postcode_col: str = "POSTCODE", coord_postcode: str = "POSTCODE") -> DataFrame:
    """Inner join on upper-case postcodes without white space."""
    right = coordinates.select(postcode(F.col(coord_postcode)).alias("__pc"), *(c for c in coordinates.columns if c.upper() != coord_postcode.upper()))
    return df.withColumn(postcode_col, postcode(F.col(postcode_col))).join(right, F.col(postcode_col) == F.col("__pc")).drop("__pc")


def address_key(*parts: Column) -> Column:
    """Lower case, no white space; null parts count as empty."""
    return F.lower(F.regexp_replace(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), r"\s+", ""))


def join_installations(df: DataFrame, register: DataFrame, key: Column, register_key: str = "compressed_epc_address", date: str = "date", values: dict[str, str] | None = None, tie: str | None = None) -> DataFrame:
    """Left join of the register's earliest record of each address. `values`: the register's columns and their new names; the date is HP_INSTALL_DATE."""
    values, ties = values or {}, [F.col(tie)] if tie else []
    order = F.struct(F.col(date), *ties)
    known = register.where(F.col(register_key).isNotNull())
    first = known.groupBy(F.col(register_key).alias("__key")).agg(F.min(date).alias("HP_INSTALL_DATE"), *(F.min_by(F.col(c), order).alias(n) for c, n in values.items()))
    return df.withColumn("__address", key).join(first, F.col("__address") == F.col("__key"), "left").drop("__address", "__key")


def union_tables(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def only_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def not_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")
