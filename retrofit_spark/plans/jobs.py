"""The jobs that put the operators together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, encode, features
from ..operators import areas, entries, installs, joins, sampling
from ..sources import readers

#: What must not be known of a property whose present status is to be told.
STATUS_LEAKS = ("HEATING_SYSTEM", "HEATING_FUEL", "HP_TYPE", "MAINHEAT_DESCRIPTION", "SECONDHEAT_DESCRIPTION", "HP_INSTALL_DATE", "FIRST_HP_MENTION")


def preprocess(raw: DataFrame, root: str | None = None, snapshot: str | None = None, key: str = "UPRN") -> DataFrame:
    """Clean, add features, keep each property's latest entry; with a root, each stage is written and the next reads it."""
    spark, stage = raw.sparkSession, raw

    def kept(df, name):
        if root is None:
            return df
        readers.write_stage(df, root, name, snapshot)
        return readers.read_stage(spark, root, name, snapshot)

    stage = kept(stage, "raw")
    stage = kept(features.with_additional_features(clean.clean_certificates(stage)), "preprocessed")
    return kept(entries.filter_by_year(stage, key, None, selection="latest entry"), "preprocessed_dedupl")


def prepare(certificates: DataFrame, imd: DataFrame, register: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    """Deprivation and installation dates joined, dates reconciled, postcode levels added."""
    placed = joins.join_deprivation(certificates, imd)
    c = placed["POSTCODE"]
    dated = joins.join_installations(placed, register, joins.address_key(placed["ADDRESS1"], placed["ADDRESS2"], c), values=values)
    return clean.with_postcode_levels(installs.reconcile_install_dates(dated))


def labelled(df: DataFrame, version: str, *, key: str = "UPRN", tie: str = "BUILDING_REFERENCE_NUMBER", balanced: bool = False, drop: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(rows with labels, names of the labels) for one of three questions."""
    if version == "Current HP Status":
        rows, targets = entries.pick_entry(df, key, "latest entry", tie=tie), ["HP_INSTALLED"]
        rows = rows.drop(*STATUS_LEAKS)
    elif version == "Future HP Status":
        rows, targets = entries.status_changes(df, key, tie=tie), ["HP_ADDED"]
        rows = rows.drop(*STATUS_LEAKS, "HP_INSTALLED")
    elif version == "HP Growth by Area":
        rows, targets = df, ["GROWTH", "HP_COVERAGE_FUTURE"]
    else:
        raise ValueError(f"version {version!r}: choose 'Current HP Status', 'Future HP Status' or 'HP Growth by Area'")
    rows = rows.drop(*drop)
    if balanced and len(targets) == 1:
        rows = sampling.balance(rows, targets[0], tie)
    return rows, targets


def growth_by_area(df: DataFrame, area: str, source_year: int, target_year: int, **options) -> DataFrame:
    return areas.area_training_table(df, area, source_year, target_year, **options)


def household_encoding(df: DataFrame, path: str | None = None) -> DataFrame:
    out = encode.encode_households(df)
    if path is None:
        return out
    out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def coverage_of_latest(df: DataFrame, area: str = "POSTCODE_AREA", key: str = "UPRN", tie: str = "BUILDING_REFERENCE_NUMBER") -> DataFrame:
    """Properties, heat pumps and their share by area, from each property's latest entry."""
    latest = entries.pick_entry(df, key, "latest entry", tie=tie)
    counts = latest.where(F.col(area).isNotNull()).groupBy(area).agg(F.count(F.lit(1)).alias("properties"), F.count_if("HP_INSTALLED").alias("heat_pumps"))
    return counts.withColumn("coverage", F.round(F.try_divide("heat_pumps", "properties"), 6))
