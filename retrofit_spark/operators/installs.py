"""Reconciling installation dates of the register with certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entries import has_key

BEFORE, AFTER = "EPC HP entry before MCS", "No EPC HP entry after MCS"


def reconcile_install_dates(df: DataFrame, key: str = "UPRN", date: str = "INSPECTION_DATE", installed: str = "HP_INSTALLED", install_date: str = "HP_INSTALL_DATE", tie: str = "BUILDING_REFERENCE_NUMBER") -> DataFrame:
    """Certificates with what their property's history says about its heat pump, in one pass over properties.

    Adds FIRST_HP_MENTION, ANY_HP, HP_AT_FIRST, HP_AT_LAST, HP_LOST, HP_ADDED, HP_IN_THE_MIDDLE, MCS_AVAILABLE,
    HAS_HP_AT_SOME_POINT, ARTIFICIALLY_DUPL and two flags of contradictions. Rows without a date go. Where a property
    never shows a heat pump but the register has one, its rows from before the installation are repeated as of that day
    with a heat pump, and the originals lose the date.
    """
    d, hp, when = F.col(date), F.col(installed), F.col(install_date)
    # Rows without a key have no history; they are spread by their tie, each a history of its own, and get nulls.
    keyed = has_key(key)
    own = Window.partitionBy(F.when(keyed, F.col(key)), F.when(~keyed, F.col(tie)))
    only = lambda c: F.when(keyed, c)
    facts = df.where(d.isNotNull()).withColumns(
        {
            "FIRST_HP_MENTION": only(F.min(F.when(hp, d)).over(own)),
            "ANY_HP": only(F.bool_or(hp).over(own)),
            "HP_AT_FIRST": only(F.min_by(hp, F.struct(d, F.col(tie))).over(own)),
            "HP_AT_LAST": only(F.max_by(hp, F.struct(d, -F.col(tie))).over(own)),
            "MCS_AVAILABLE": when.isNotNull(),
            "ARTIFICIALLY_DUPL": F.lit(False),
        }
    )
    first, last, mention = F.col("HP_AT_FIRST"), F.col("HP_AT_LAST"), F.col("FIRST_HP_MENTION")
    before = F.coalesce(d < when, F.lit(False))
    mcs = F.col("MCS_AVAILABLE")
    erase = mcs & ~hp & before
    facts = facts.withColumns(
        {
            "HP_LOST": first & ~last,
            "HP_ADDED": ~first & last,
            "HP_IN_THE_MIDDLE": ~first & ~last & mention.isNotNull(),
            "HAS_HP_AT_SOME_POINT": mention.isNotNull(),
            BEFORE: mcs & hp & before,
            AFTER: mcs & ~hp & ~before,
            "__erase": erase,
            "__twice": F.when(erase & mention.isNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))),
        }
    )
    twice = facts.withColumn("__dup", F.explode("__twice")).drop("__twice")
    dup = F.col("__dup")
    out = twice.withColumns(
        {
            date: F.when(dup, when).otherwise(d),
            installed: hp | dup,
            "HAS_HP_AT_SOME_POINT": F.col("HAS_HP_AT_SOME_POINT") | dup,
            "ARTIFICIALLY_DUPL": dup,
            install_date: F.when(dup, when).when(F.col("__erase"), F.lit(None)).when(~mcs & hp, mention).otherwise(when),
        }
    )
    return out.drop("__erase", "__dup")


def audit_cases(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """How many rows meet each condition, in one aggregate."""
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def install_audit(df: DataFrame, installed: str = "HP_INSTALLED", date: str = "INSPECTION_DATE", install_date: str = "HP_INSTALL_DATE", some: str = "HAS_HP_AT_SOME_POINT") -> DataFrame:
    """Counts of the cases that register and certificates make together."""
    mcs, hp = F.col(install_date).isNotNull(), F.col(installed)
    before = F.coalesce(F.col(date) < F.col(install_date), F.lit(False))
    return audit_cases(
        df,
        {
            "either": mcs | hp,
            "mcs_and_hp": mcs & hp,
            "mcs_no_hp": mcs & ~hp,
            "no_mcs_hp": ~mcs & hp,
            "mcs_hp_before": mcs & hp & before,
            "mcs_hp_after": mcs & hp & ~before,
            "mcs_no_hp_before": mcs & ~hp & before,
            "mcs_no_hp_after": mcs & ~hp & ~before,
            "mcs_no_hp_before_never": mcs & ~hp & before & ~F.col(some),
        },
    )


def gap_audit(df: DataFrame, group: str, later: str, earlier: str, days: int = 365) -> DataFrame:
    """Rows of each group whose dates lie more than so many days apart, and all rows with both dates."""
    gap = F.datediff(F.col(later), F.col(earlier))
    return df.where(gap.isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(gap > days).alias("n_more"))
