"""Features of certificates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookups as L


def unique_address(address: Column, postcode: Column) -> Column:
    return F.concat(F.upper(address), F.upper(postcode))


def building_id_sql(x: str) -> str:
    """The first 16 digits of the MD5 of a text read as a 128-bit number, as SQL text.

    2**64 is 1844674407 * 10**10 + 3709551616, so the number is put together from decimals of two halves. Digest, halves and
    sums are each bound once by a lambda.
    """
    half = "cast(conv(substring(h, {at}, 16), 16, 10) as decimal(20,0))"
    halves = f"transform(array(md5({x})), h -> named_struct('high', {half.format(at=1)}, 'low', {half.format(at=17)}))"
    tails = f"transform({halves}, v -> named_struct('high', v.high, 'tail', v.high * 3709551616BD + v.low))"
    parts = f"transform({tails}, v -> named_struct('top', v.high * 1844674407BD + cast(v.tail div 10000000000BD as decimal(20,0)), 'rest', cast(v.tail % 10000000000BD as string)))"
    number = "if(v.top > 0, concat(cast(v.top as string), lpad(v.rest, 10, '0')), v.rest)"
    return f"transform({parts}, v -> cast(substring({number}, 1, 16) as bigint))[0]"


def rating_number(c: Column) -> Column:
    return L.lookup(c, L.RATING_NUMBERS)


def rating_class(c: Column) -> Column:
    return L.lookup(c, L.RATING_CLASSES)


def rating_gain(current: Column, potential: Column) -> Column:
    """Steps from the current to the potential rating; null outside 0 to 7."""
    gain = rating_number(potential) - rating_number(current)
    return F.when(gain.between(0, 7), gain)


def with_rating_features(df: DataFrame, current: str = "CURRENT_ENERGY_RATING", potential: str = "POTENTIAL_ENERGY_RATING") -> DataFrame:
    names = {x.upper() for x in df.columns}
    if current.upper() not in names:
        return df
    new = {"CURR_ENERGY_RATING_NUM": rating_number(F.col(current)), "ENERGY_RATING_CAT": rating_class(F.col(current))}
    if potential.upper() in names:
        new["DIFF_POT_ENERGY_RATING"] = rating_gain(F.col(current), F.col(potential))
    return df.withColumns(new)


def quality_score(c: Column) -> Column:
    return L.lookup(c, {k: float(v) for k, v in L.EFFICIENCY_SCORES.items()})


def mean_rating_class(c: Column, fix_quirks: bool = False) -> Column:
    """Class of a mean rating number; exactly 7 has none unless quirks are fixed."""
    out = F.when(c < 2, "F-G").when(c < 3, "E-F").when(c < 4, "D-E").when(c < 5, "C-D").when(c < 6, "B-C").when(c < 7, "A-B")
    return out.when(c == 7, "A-B") if fix_quirks else out


def heat_pump_share_class(c: Column, fix_quirks: bool = False) -> Column:
    """Class of a percentage; above 7 has none unless quirks are fixed."""
    out = F.when(c <= 0, "0.0 %").when(c <= 0.5, "0.0 - 0.5 %").when(c <= 2, "0.5 - 2.0 %").when(c <= 5, "2.0 - 5.0 %").when(c <= 7, "5.0 % +")
    return out.when(c > 7, "5.0 % +") if fix_quirks else out


def _first(text: Column, tests: list[tuple[str, str]], default: Column) -> Column:
    """The value of the first test whose words the text holds."""
    return reduce(lambda later, test: F.when(text.contains(test[0]), test[1]).otherwise(later), reversed(tests), default)


def heating(main: Column, second: Column, fine_grained: bool = False) -> dict[str, Column]:
    """HEATING_SYSTEM, HEATING_FUEL, HP_INSTALLED and HP_TYPE of descriptions."""
    text = F.lower(main)
    unknown = F.lit(L.UNKNOWN)
    pump = _first(text, [(w, w) for w in L.HEAT_PUMPS], F.lit(None).cast("string"))
    electric = _first(text, list(L.ELECTRIC_SYSTEMS.items()), F.lit(None).cast("string"))
    other = _first(text, list(L.OTHER_SYSTEMS.items())[::-1], F.lit(None).cast("string"))
    fuel = _first(text, list(L.FUELS.items())[::-1], unknown)
    is_pump = F.coalesce(text.contains("heat pump"), F.lit(False))
    system = F.coalesce(pump if fine_grained else F.when(is_pump, "heat pump"), electric, other, unknown)
    said = lambda c, w: F.coalesce(F.lower(c).contains(w), F.lit(False))
    installed = reduce(lambda a, w: a | said(main, w), L.FOREIGN_HEAT_PUMPS, is_pump | said(second, "heat pump"))
    return {
        "HEATING_SYSTEM": system,
        "HEATING_FUEL": F.when(is_pump | electric.isNotNull(), "electric").when(other.isNotNull(), fuel).otherwise(unknown),
        "HP_INSTALLED": installed,
        "HP_TYPE": F.when(is_pump, pump).otherwise("No HP"),
    }


def with_heating(df: DataFrame, main: str = "MAINHEAT_DESCRIPTION", second: str = "SECONDHEAT_DESCRIPTION", fine_grained: bool = False) -> DataFrame:
    return df.withColumns(heating(F.col(main), F.col(second), fine_grained))


def _system_and_fuel(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, ",")
    joined = r"(.+)(with|utilising)(.+)"
    comma, word = text.contains(","), text.rlike(joined)
    system = F.when(comma, F.get(parts, F.lit(0))).when(word, F.regexp_extract(text, joined, 1)).otherwise(text)
    fuel = F.when(comma, F.element_at(parts, -1)).when(word, F.regexp_extract(text, joined, 3)).otherwise(L.UNKNOWN)
    tidy = lambda c: F.coalesce(F.nullif(F.trim(F.lower(c)), F.lit("")), F.lit(L.UNKNOWN))
    return tidy(system), tidy(fuel)


def split_heating(description: Column, normalise: bool = True) -> dict[str, Column]:
    """First and second heating, each as system and fuel; names are normalised through the fixed maps, unlisted ones are null."""
    parts = F.split(description, r"\|")
    first, second = F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    out = {}
    for name, text in (("FIRST", first), ("SECOND", second)):
        system, fuel = _system_and_fuel(text)
        if normalise:
            system, fuel = L.lookup(system, L.SYSTEM_NAMES | {L.UNKNOWN: L.UNKNOWN}), L.lookup(fuel, L.FUEL_NAMES)
        out |= {f"{name}_HEATING_SYSTEM": system, f"{name}_HEATING_FUEL": fuel}
    return out


def with_building_id(df: DataFrame, address: str = "ADDRESS1", postcode: str = "POSTCODE") -> DataFrame:
    """UNIQUE_ADDRESS and BUILDING_ID; rows without an address go."""
    named = df.where(F.col(address).isNotNull()).withColumn("UNIQUE_ADDRESS", unique_address(F.col(address), F.col(postcode)))
    return named.withColumn("BUILDING_ID", F.expr(building_id_sql("UNIQUE_ADDRESS")))


def with_additional_features(df: DataFrame, keys: dict[str, str] | None = None, fine_grained: bool = False) -> DataFrame:
    """Address and building ids, entry counts, heating and rating features."""
    from ..operators.entries import with_entry_counts

    keys = keys or {"N_ENTRIES": "BUILDING_REFERENCE_NUMBER", "N_ENTRIES_BUILD_ID": "BUILDING_ID", "N_SAME_UPRN_ENTRIES": "UPRN"}
    return with_rating_features(with_heating(with_entry_counts(with_building_id(df), keys), fine_grained=fine_grained))
