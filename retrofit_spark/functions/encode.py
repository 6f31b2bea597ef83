"""Encoding of categories for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import lookups as L


def reduce_categories(df: DataFrame, reductions: dict | None = None) -> DataFrame:
    """Merged categories; null is unknown, unlisted values are null."""
    here = {c.upper(): c for c in df.columns}
    return df.withColumns({here[k]: F.when(F.col(here[k]).isNull(), L.UNKNOWN).otherwise(L.lookup(F.col(here[k]), v)) for k, v in (reductions or L.REDUCTIONS).items() if k in here})


def efficiency_value(c: Column) -> Column:
    """Mean of one or more labels parted by bars, to one decimal, halves to even; 0 where there is none."""
    parts = F.filter(F.transform(F.split(c, r"\|"), lambda p: F.trim(p)), lambda p: ~p.isin("N/A", L.UNKNOWN, ""))
    scores = F.transform(parts, lambda p: L.lookup(p, L.EFFICIENCY_SCORES))
    mean = F.aggregate(scores, F.lit(0), lambda a, s: a + s) / F.size(scores)
    return F.coalesce(F.when(F.size(parts) > 0, F.bround(mean.cast("double"), 1)), F.lit(0.0))


def ordinal(c: Column, order: list) -> Column:
    """1 for the first of `order`, and so on; anything else is null."""
    return L.lookup(c, {v: k for k, v in enumerate(order, 1)})


def encode_ordinal(df: DataFrame, features: list[str], orders: dict | None = None) -> DataFrame:
    """Ordinal features by their order, *_EFF by their mean score; absent ones are skipped."""
    here, orders, new = {c.upper(): c for c in df.columns}, orders or L.ORDERS, {}
    for f in (f.upper() for f in features):
        if f in here and f.endswith("_EFF"):
            new[here[f]] = efficiency_value(F.col(here[f]))
        elif f in here and f in orders:
            new[here[f]] = ordinal(F.col(here[f]).cast("string"), orders[f])
    return df.withColumns(new)


def categories(df: DataFrame, features: list[str], most: int = 10_000) -> dict[str, list]:
    """Sorted distinct values of each feature, null left out. They come to the driver as column names do; a feature with more than `most` is no category and raises."""
    if not features:
        return {}
    sizes = df.agg(*(F.approx_count_distinct(F.col(f"`{f}`").cast("string")).alias(f"n{k}") for k, f in enumerate(features))).head()
    if wide := [f for k, f in enumerate(features) if sizes[k] > most]:
        raise ValueError(f"more than {most} values: {', '.join(wide)}")
    found = df.agg(*(F.array_sort(F.collect_set(F.col(f"`{f}`").cast("string"))).alias(f"f{k}") for k, f in enumerate(features))).head()
    return {f: found[k] for k, f in enumerate(features)}


def one_hot(df: DataFrame, features: list[str], values: dict[str, list] | None = None) -> DataFrame:
    """A column "feature: category" for each category, 0 or 1, null giving 0 in all; categories ending in False, and the feature itself, are dropped."""
    values = values or categories(df, features)
    made = [
        F.coalesce((F.col(f"`{f}`").cast("string") == v), F.lit(False)).cast("int").alias(f"{f}: {v}")
        for f in features for v in values[f] if not f"{f}: {v}".lower().endswith("false")
    ]
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in features), *made)


def encode_features(df: DataFrame, ordinal_features: list[str], *, reduce: bool = True, onehot: str | list[str] | None = "auto", unaltered: str | list[str] | None = None, drop: list[str] = (), values: dict | None = None) -> DataFrame:
    """Drop, reduce, encode ordinally, one-hot encode what is left of the categories (or the features named)."""
    missing = [c for c in drop if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns to drop: {missing}")
    df = df.drop(*drop)
    df = reduce_categories(df) if reduce else df
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name.upper() not in ("BUILDING_ID", "UPRN")}
    df = encode_ordinal(df, ordinal_features)
    if not onehot:
        return df
    keep = {unaltered} if isinstance(unaltered, str) else set(unaltered or ())
    order = {f.upper() for f in ordinal_features}
    features = [c for c in df.columns if c.upper() not in order and c not in numbers and c not in keep] if onehot == "auto" else list(onehot)
    return one_hot(df, features, values)


# What the household encoding treats as ordinal, leaves alone, and drops.
HOUSEHOLD_ORDINAL = (
    "MAINHEAT_ENERGY_EFF", "CURRENT_ENERGY_RATING", "POTENTIAL_ENERGY_RATING", "FLOOR_ENERGY_EFF", "WINDOWS_ENERGY_EFF",
    "HOT_WATER_ENERGY_EFF", "LIGHTING_ENERGY_EFF", "GLAZED_TYPE", "MAINHEATC_ENERGY_EFF", "WALLS_ENERGY_EFF", "ROOF_ENERGY_EFF",
    "MAINS_GAS_FLAG", "CONSTRUCTION_AGE_BAND_ORIGINAL", "CONSTRUCTION_AGE_BAND", "ENERGY_RATING_CAT",
)
HOUSEHOLD_UNALTERED = ("POSTCODE", "POSTCODE_AREA", "POSTCODE_DISTRICT", "POSTCODE_SECTOR", "POSTCODE_UNIT", "HP_INSTALLED", "N_SAME_UPRN_ENTRIES", "HP_INSTALL_DATE", "INSPECTION_DATE", "UPRN")
HOUSEHOLD_DROPPED = (
    "BUILDING_REFERENCE_NUMBER", "ADDRESS1", "ADDRESS2", "POSTTOWN", "LODGEMENT_DATE", "CO2_EMISS_CURR_PER_FLOOR_AREA",
    "MAINHEAT_DESCRIPTION", "SHEATING_ENERGY_EFF", "HEATING_COST_POTENTIAL", "HOT_WATER_COST_POTENTIAL",
    "LIGHTING_COST_POTENTIAL", "CONSTRUCTION_AGE_BAND", "NUMBER_HEATED_ROOMS", "LOCAL_AUTHORITY_LABEL",
    "CURR_ENERGY_RATING_NUM", "ENERGY_RATING_CAT", "UNIQUE_ADDRESS", "MAIN_FUEL", "IMD_COUNTRY", "original_address",
    "FIRST_HP_MENTION", "MCS_AVAILABLE", "HAS_HP_AT_SOME_POINT", "HP_TYPE", "version", "n_certificates", "# records",
    "MCS address", "alt_type", "installation_type", "ANY_HP", "HP_AT_FIRST", "HP_AT_LAST", "HP_LOST", "HP_IN_THE_MIDDLE",
    "ARTIFICIALLY_DUPL", "EPC HP entry before MCS", "No EPC HP entry after MCS", "N_ENTRIES", "N_ENTRIES_BUILD_ID",
)


def encode_households(df: DataFrame, values: dict | None = None) -> DataFrame:
    """The household encoding; columns to drop that aren't there are passed over."""
    out = encode_features(df, list(HOUSEHOLD_ORDINAL), unaltered=list(HOUSEHOLD_UNALTERED), drop=[c for c in HOUSEHOLD_DROPPED if c in df.columns], values=values)
    counts = {"N_SAME_UPRN_ENTRIES"} & set(out.columns)
    return out.withColumns({c: ordinal(F.col(c).cast("string"), L.ORDERS[c]) for c in counts})
