"""Cleaning of certificates. Every function gives a column expression; nothing runs until the frame is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookups as L

# Numeric columns, those among them that hold text when read, and dates.
NUMERIC = (
    "ENERGY_CONSUMPTION_CURRENT", "TOTAL_FLOOR_AREA", "CURRENT_ENERGY_EFFICIENCY", "CO2_EMISS_CURR_PER_FLOOR_AREA",
    "HEATING_COST_CURRENT", "HEATING_COST_POTENTIAL", "HOT_WATER_COST_CURRENT", "HOT_WATER_COST_POTENTIAL",
    "LIGHTING_COST_CURRENT", "LIGHTING_COST_POTENTIAL", "WIND_TURBINE_COUNT", "MAIN_HEATING_CONTROLS",
    "MULTI_GLAZE_PROPORTION", "FLOOR_HEIGHT", "EXTENSION_COUNT", "NUMBER_HEATED_ROOMS", "FLOOR_LEVEL",
    "NUMBER_HABITABLE_ROOMS", "CO2_EMISSIONS_CURRENT",
)
DATES = ("LODGEMENT_DATE", "INSPECTION_DATE")
EFFICIENCY_COLUMNS = ("WINDOWS_ENERGY_EFF", "FLOOR_ENERGY_EFF", "HOT_WATER_ENERGY_EFF", "LIGHTING_ENERGY_EFF")


def missing(c: Column) -> Column:
    return c.isNull() | c.isin(*L.SENTINELS)


def known_or_unknown(c: Column) -> Column:
    """Text with every stand-in for a missing value made "unknown"."""
    return F.when(missing(c), L.UNKNOWN).otherwise(c)


def numeric(c: Column, negatives: bool = False, strict: bool = False) -> Column:
    """A number; stand-ins are null, negative ones too unless allowed; other text is null, or raises if strict."""
    plain = F.when(~missing(c.cast("string")), c)
    value = plain.cast("double") if strict else plain.cast("string").try_cast("double")
    return value if negatives else F.when(value >= 0, value)


def standard_date(c: Column, min_year: int | None = None, max_year: int | None = None) -> Column:
    """A date from yyyy-MM-dd, yyyy/MM/dd or dd/MM/yyyy; years written 00yy are 20yy; anything else is null."""
    text = F.regexp_replace(c.cast("string"), r"^00(\d\d)", r"20$1")
    found = F.coalesce(*(F.try_to_date(text, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy")))
    if min_year is not None:
        found = F.when(found >= F.lit(f"{min_year}-01-01").cast("date"), found)
    if max_year is not None:
        found = F.when(found < F.lit(f"{max_year + 1}-01-01").cast("date"), found)
    return found


def date_text(c: Column, min_year: int = 2008, max_year: int = L.CURRENT_YEAR + 1) -> Column:
    """y/m/d as text from y-m-d or d/m/y; "unknown" for other text, years that aren't four digits, and years out of bounds."""
    dash, slash = F.split(c, "-"), F.split(c, "/")
    by_dash = c.contains("-")
    year = F.when(by_dash, F.get(dash, F.lit(0))).when(c.contains("/"), F.get(slash, F.lit(2)))
    month = F.when(by_dash, F.get(dash, F.lit(1))).otherwise(F.get(slash, F.lit(1)))
    day = F.when(by_dash, F.get(dash, F.lit(2))).otherwise(F.get(slash, F.lit(0)))
    year = F.when(year.startswith("00"), F.concat(F.lit("20"), F.right(year, F.lit(2)))).otherwise(year)
    good = year.rlike(r"^\d{4}$") & year.try_cast("int").between(min_year, max_year)
    return F.when(good, F.concat_ws("/", year, month, day)).otherwise(L.UNKNOWN)


def year_of_text(c: Column) -> Column:
    """The year of y/m/d text; null where it isn't four digits."""
    return F.regexp_extract(c, r"^(\d{4})(/|$)", 1).try_cast("int")


def text_date_as_int(c: Column) -> Column:
    """yyyymmdd of y/m/d text as a number; -1 for unknown."""
    return F.when(c.isNull() | (c == L.UNKNOWN), F.lit(-1)).otherwise(F.regexp_replace(c, "/", "").try_cast("int"))


def solar_flag(c: Column) -> Column:
    return L.lookup(c, L.SOLAR_FLAGS, L.UNKNOWN)


def floor_level(c: Column, as_numeric: bool = True, fix_quirks: bool = False) -> Column:
    """-1 to 10, null where unknown; or as a category, "10+" and "unknown" among them."""
    level = L.lookup(c, L.floor_levels(fix_quirks))
    if as_numeric:
        return level.cast("double")
    return F.when(level == 10, "10+").otherwise(F.coalesce(level.cast("string"), F.lit(L.UNKNOWN)))


def tenure(c: Column, strict: bool = False) -> Column:
    return L.strict_lookup(F.lower(c), L.TENURES, L.UNKNOWN) if strict else L.lookup(F.lower(c), L.TENURES, L.UNKNOWN)


def age_band(c: Column, merged: bool = True) -> Column:
    return L.lookup(F.trim(c), L.age_bands(merged), L.UNKNOWN)


def efficiency(c: Column, strict: bool = False) -> Column:
    """One of five labels or "unknown", from any case and with quotes or bars around it."""
    plain = F.trim(F.lower(c))
    for mark in ('"', "|"):
        plain = F.trim(F.regexp_replace(plain, rf"^[{mark}]+|[{mark}]+$", ""))
    return L.strict_lookup(plain, L.EFFICIENCIES, L.UNKNOWN) if strict else L.lookup(plain, L.EFFICIENCIES, L.UNKNOWN)


def glazed_area(c: Column, as_numeric: bool = True) -> Column:
    level = L.lookup(c, L.GLAZED_AREAS)
    return level.cast("double") if as_numeric else L.lookup(level, L.GLAZED_AREA_NAMES, L.UNKNOWN)


def local_authority(c: Column) -> Column:
    return F.when(c.isin(*L.UNNAMED_AUTHORITIES), L.UNKNOWN).otherwise(c)


def photo_supply(c: Column, fix_quirks: bool = False) -> Column:
    """Share of the roof with panels. A plain number without a mark after it is null, unless quirks are fixed."""
    marked = F.regexp_extract(c, r"(\d+)[%\|.d$]", 1)
    found = F.nullif(marked, F.lit("")).try_cast("double")
    plain = F.when(c.rlike(r"^\s*\d+\s*$"), F.trim(c).try_cast("double")) if fix_quirks else F.lit(None).cast("double")
    return F.when(~c.contains("Peak Power"), F.coalesce(found, plain))


def cap(c: Column, n: float) -> Column:
    return F.when(c >= n, F.lit(n).cast("double")).otherwise(c)


def postcode(c: Column) -> Column:
    return F.upper(F.translate(c, " \t\n\x0b\f\r", ""))


LEVELS = ("area", "district", "sector", "unit")


def postcode_level(c: Column, level: str, with_space: bool = True) -> Column:
    """Part of a postcode: YO, YO30, YO30 5 or YO30 5QW. Too short ones are null."""
    text = F.trim(c)
    gap = F.lit(" " if with_space else "")
    n = F.length(text)
    first, last = F.trim(F.substring(text, F.lit(1), n - 3)), F.trim(F.right(text, F.lit(3)))
    whole = F.when(n > 3, F.lit(True))
    if level == "area":
        return F.nullif(F.regexp_extract(text, "([A-Z]+)", 1), F.lit(""))
    if level == "district":
        return F.when(whole, first)
    if level == "sector":
        return F.when(whole, F.concat(first, gap, F.substring(last, 1, 1)))
    if level == "unit":
        return F.when(whole, F.concat(first, gap, last))
    raise ValueError(f"postcode level {level!r}: choose one of {', '.join(LEVELS)}")


def with_postcode_levels(df: DataFrame, postcode_col: str = "POSTCODE", only: str | None = None, with_space: bool = True) -> DataFrame:
    return df.withColumns({f"POSTCODE_{level.upper()}": postcode_level(F.col(postcode_col), level, with_space) for level in ([only] if only else LEVELS)})


def clean_certificates(df: DataFrame, *, fix_quirks: bool = False, strict: bool = False, room_cap: int = 10) -> DataFrame:
    """All cleaning in one projection; columns that the frame lacks are passed over."""
    out = []
    for name in df.columns:
        c, key = F.col(f"`{name}`"), name.upper()
        text = known_or_unknown(c.cast("string"))
        if key == "NUMBER_HABITABLE_ROOMS":
            new = cap(numeric(c, strict=strict), room_cap)
        elif key == "FLOOR_LEVEL":
            new = floor_level(F.when(~missing(c), c), fix_quirks=fix_quirks)
        elif key in NUMERIC:
            new = numeric(c, strict=strict)
        elif key in DATES:
            new = standard_date(text)
        elif key == "CONSTRUCTION_AGE_BAND":
            out.append(age_band(text, merged=False).alias("CONSTRUCTION_AGE_BAND_ORIGINAL"))
            new = age_band(text)
        elif key == "POSTCODE":
            new = postcode(text)
        elif key == "PHOTO_SUPPLY":
            new = photo_supply(text, fix_quirks)
        elif key == "TENURE":
            new = tenure(text, strict)
        elif key in EFFICIENCY_COLUMNS:
            new = efficiency(text, strict)
        elif key == "LOCAL_AUTHORITY_LABEL":
            new = local_authority(text)
        elif key == "SOLAR_WATER_HEATING_FLAG":
            new = solar_flag(text)
        elif key == "GLAZED_AREA":
            new = glazed_area(text)
        else:
            new = text
        out.append(new.alias(name))
    return df.select(*out)
