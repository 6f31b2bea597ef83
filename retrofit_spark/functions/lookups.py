"""Literal maps, and how they are applied as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
CURRENT_YEAR = 2021

# Tokens that stand for a missing value.
SENTINELS = (
    "unknown", "%%MAINHEATCONTROL%%", "NODATA!", "NO DATA!", "INVALID!", "not defined", "none of the above",
    "no data!", "nodata!", "Not applicable", "Not Defined", "Unknown", "not recorded",
)

# Local authority codes without a name.
UNNAMED_AUTHORITIES = ("00EM", "16UD")

# Flags of solar water heating.
SOLAR_FLAGS = {"N": "False", "false": "False", "Y": "True", "true": "True"}

# Tenure, by its lower-case spelling.
TENURES = {
    "owner-occupied": "owner-occupied",
    "rental (social)": "rental (social)",
    "rented (social)": "rental (social)",
    "rental (private)": "rental (private)",
    "rented (private)": "rental (private)",
    "unknown": UNKNOWN,
    "no data!": UNKNOWN,
    "not defined - use in the case of a new dwelling for which the intended tenure in not known. it is no": UNKNOWN,
}

# Efficiency labels, by their lower-case spelling without quotes and bars at the ends.
EFFICIENCIES = {
    "very poor": "Very Poor",
    "poor": "Poor",
    "average": "Average",
    "good": "Good",
    "very good": "Very Good",
    "n/a": UNKNOWN,
    "n/a | n/a": UNKNOWN,
    "n/a | n/a | n/a": UNKNOWN,
    "n/a | n/a | n/a | n/a": UNKNOWN,
    "no data!": UNKNOWN,
    "unknown": UNKNOWN,
}
EFFICIENCY_SCORES = {"Very Poor": 1, "Poor": 2, "Average": 3, "Good": 4, "Very Good": 5}

# Energy ratings.
RATING_NUMBERS = {"A": 7.0, "B": 6.0, "C": 5.0, "D": 4.0, "E": 3.0, "F": 2.0, "G": 1.0}
RATING_CLASSES = {"A": "A-B", "B": "A-B", "C": "C-D", "D": "C-D", "E": "E-G", "F": "E-G", "G": "E-G", "unknown": UNKNOWN}

# Glazed area.
GLAZED_AREAS = {
    "1": 1, "2": 2, "3": 3, "4": 4, "5": 5,
    "Much Less Than Typical": 1, "Less Than Typical": 2, "Normal": 3, "More Than Typical": 4, "Much More Than Typical": 5,
}
GLAZED_AREA_NAMES = {1: "Much Less Than Typical", 2: "Less Than Typical", 3: "Normal", 4: "More Than Typical", 5: "Much More Than Typical"}


def floor_levels(fix_quirks: bool = False) -> dict[str, int]:
    """Every spelling of a floor, by rule: 7 as 7, 07, 7.0 or 7th; all above the tenth count as the tenth. "3.0" is 2 unless quirks are fixed."""
    ordinal = {1: "st", 2: "nd", 3: "rd"}
    found = {"-1.0": -1, "Basement": -1, "Ground": 0, "0": 0, "00": 0, "0.0": 0, "mid floor": 5, "top floor": 10, "20+": 10, "21st or above": 10}
    for n in range(1, 21):
        level = min(n, 10)
        found |= {str(n): level, f"{n}{ordinal.get(n, 'th')}": level}
        if n < 10:
            found |= {f"0{n}": level}
        if n <= 10:
            found |= {f"{n}.0": level}
    return found if fix_quirks else found | {"3.0": 2}


# Construction age bands.
_ENGLISH_BANDS = (
    "before 1900", "1900-1929", "1930-1949", "1950-1966", "1967-1975", "1976-1982", "1983-1990", "1991-1995",
    "1996-2002", "2003-2006", "2007-2011", "2007 onwards", "2012 onwards",
)
_SCOTTISH_BANDS = (
    "before 1919", "1919-1929", "1930-1949", "1950-1964", "1965-1975", "1976-1983", "1984-1991", "1992-1998",
    "1999-2002", "2003-2007", "2008 onwards",
)
_MERGED_ENGLISH = (
    "England and Wales: before 1900", "1900-1929", "1930-1949", "1950-1966", "1965-1975", "1976-1983", "1983-1991", "1991-1998",
    "1996-2002", "2003-2007", "2007 onwards", "2007 onwards", "2007 onwards",
)
_MERGED_SCOTTISH = (
    "Scotland: before 1919", "1900-1929", "1930-1949", "1950-1966", "1965-1975", "1976-1983", "1983-1991", "1991-1998",
    "1996-2002", "2003-2007", "2007 onwards",
)


def age_bands(merged: bool = True) -> dict[str, str]:
    """Construction age bands: merged across countries, or as they were with their country. Single years fall into a band."""
    english = [f"England and Wales: {b}" for b in _ENGLISH_BANDS]
    if merged:
        found = dict(zip(english, _MERGED_ENGLISH, strict=True)) | dict(zip(_SCOTTISH_BANDS, _MERGED_SCOTTISH, strict=True))
        return found | {"1900": "1900-1929"} | {str(y): "2007 onwards" for y in range(2007, 2022)}
    found = {b: b for b in english} | {b: f"Scotland: {b}" for b in _SCOTTISH_BANDS}
    found["England and Wales: 2007-2011"] = "England and Wales: 2007 onwards"
    years = {str(y): f"England and Wales: {'2007' if y < 2012 else '2012'} onwards" for y in range(2007, 2022)}
    return found | {"1900": "England and Wales: 1900-1929"} | years


# Categories that are merged for encoding; null is unknown, anything else that isn't listed is null.
REDUCTIONS = {
    "GLAZED_TYPE": {
        "single glazing": "single glazing",
        "secondary glazing": "double glazing",
        "double, known data": "double glazing",
        "double glazing, unknown install date": "double glazing",
        "double glazing installed before 2002": "double glazing",
        "double glazing installed during or after 2002": "double glazing",
        "triple glazing": "triple glazing",
        "triple, known data": "triple glazing",
        "unknown": UNKNOWN,
    },
    "MECHANICAL_VENTILATION": {
        "natural": "natural",
        "mechanical, extract only": "mechanical",
        "mechanical, supply and extract": "mechanical",
        "unknown": UNKNOWN,
    },
    "ENERGY_TARIFF": {
        "Single": "single",
        "dual": "dual",
        "dual (24 hour)": "dual",
        "off-peak 7 hour": "off-peak",
        "off-peak 10 hour": "off-peak",
        "off-peak 18 hour": "off-peak",
        "standard tariff": "standard",
        "24 hour": UNKNOWN,
        "5": UNKNOWN,
        "Unknown": UNKNOWN,
        "unknown": UNKNOWN,
    },
    "TRANSACTION_TYPE": {
        "rental": "rental",
        "rental (social)": "rental (social)",
        "rental (social) - this is for backwards compatibility only and should not be used": "rental (social)",
        "rental (private)": "rental (private)",
        "rental (private) - this is for backwards compatibility only and should not be used": "rental (private)",
        "marketed sale": "marketed saled",
        "non marketed sale": "non marketed sale",
        "not sale or rental": "not sale or rental",
        "new dwelling": "new dwelling",
        "ECO assessment": "ECO assessment",
        "assessment for green deal": "green deal related",
        "following green deal": "green deal related",
        "RHI application": "green deal related",
        "FiT application": "green deal related",
        "Stock Condition Survey": "Stock Condition Survey",
        "Stock condition survey": "Stock Condition Survey",
        "not recorded": UNKNOWN,
        "not recorded - this is for backwards compatibility only and should not be used": UNKNOWN,
        "unknown": UNKNOWN,
    },
}

# Orders of ordinal features, from the first (1) upwards.
ORDERS = {
    "CURRENT_ENERGY_RATING": ["unknown", "G", "F", "E", "D", "C", "B", "A"],
    "POTENTIAL_ENERGY_RATING": ["unknown", "G", "F", "E", "D", "C", "B", "A"],
    "NUMBER_HABITABLE_ROOMS": ["unknown", *(f"{n}.0" for n in range(10)), "10+"],
    "MAINS_GAS_FLAG": ["N", "unknown", "Y"],
    "CONSTRUCTION_AGE_BAND_ORIGINAL": [
        "England and Wales: before 1900", "Scotland: before 1919",
        "England and Wales: 1900-1929", "Scotland: 1919-1929",
        "England and Wales: 1930-1949", "Scotland: 1930-1949",
        "Scotland: 1950-1964", "England and Wales: 1950-1966",
        "England and Wales: 1967-1975", "Scotland: 1965-1975",
        "England and Wales: 1976-1982", "Scotland: 1976-1983",
        "England and Wales: 1983-1990", "Scotland: 1984-1991",
        "England and Wales: 1991-1995", "Scotland: 1992-1998",
        "England and Wales: 1996-2002", "Scotland: 1999-2002",
        "England and Wales: 2003-2006", "Scotland: 2003-2007",
        "England and Wales: 2007 onwards", "Scotland: 2008 onwards",
        "England and Wales: 2012 onwards", "unknown",
    ],
    "CONSTRUCTION_AGE_BAND": [
        "England and Wales: before 1900", "Scotland: before 1919", "1900-1929", "1930-1949", "1950-1966", "1965-1975",
        "1976-1983", "1983-1991", "1991-1998", "1996-2002", "2003-2007", "2007 onwards", "unknown",
    ],
    "N_ENTRIES_BUILD_ID": ["1", "2", "3", "4", "5.0+"],
    "N_ENTRIES": ["1", "2", "3", "4", "5.0+"],
    "N_SAME_UPRN_ENTRIES": ["1", "2", "3", "4", "5.0+"],
    "FLOOR_LEVEL": ["unknown", *(str(n) for n in range(-1, 10)), "10+"],
    "ENERGY_RATING_CAT": ["unknown", "E-G", "C-D", "A-B"],
    "GLAZED_TYPE": ["unknown", "single glazing", "double glazing", "triple glazing"],
}

# Words that tell a heating system or fuel; of the last two lists the later word wins.
HEAT_PUMPS = ("ground source heat pump", "air source heat pump", "water source heat pump", "community heat pump", "heat pump")
ELECTRIC_SYSTEMS = {"electric storage heaters": "storage heater", "electric underfloor heating": "underfloor heating", "warm air": "warm air"}
OTHER_SYSTEMS = {
    "boiler and radiator": "boiler and radiator",
    "boiler & radiator": "boiler and radiator",
    "boiler and underfloor": "boiler and underfloor",
    "boiler & underfloor": "boiler and underfloor",
    "community scheme": "community scheme",
    "heater": "heater",
}
FUELS = {"gas": "gas", ", oil": "oil", "lpg": "LPG", "electric": "electric"}
FOREIGN_HEAT_PUMPS = ("pumpa teas", "pwmp gwres")

# Names of heating systems as they are split from descriptions.
SYSTEM_NAMES = {
    "boiler and radiators": "boiler and radiators",
    "boiler": "boiler and radiators",
    "boiler and": "boiler and radiators",
    "solid-fuel boiler": "boiler and radiators",
    "boiler & underfloor": "boiler and radiators",
    "boiler &amp; underfloor": "boiler and radiators",
    "bwyler a rheiddiaduron": "boiler and radiators",
    "radiator heating": "boiler and radiators",
    "gas/lpg boiler pre-1998 with balanced or open-flue": "boiler and radiators",
    "boiler and underfloor heating": "boiler and underfloor heating",
    "electric boiler": "electric boiler",
    "boiler and fan coil units": UNKNOWN,
    "electric storage": "electric storage heaters",
    "electric storage heaters": "electric storage heaters",
    "stôr wresogyddion trydan": "electric storage heaters",
    "st?r wresogyddion trydan": "room heaters",
    "room heaters": "room heaters",
    "wresogyddion ystafell": "room heaters",
    "no system present: electric heaters assumed": "no system present: electric heaters assumed",
    "portable electric heaters assumed for most rooms": "no system present: electric heaters assumed",
    "no system present": "electric heaters assumed",
    "portable electric heaters": "eletric heaters",
    "electric underfloor heating": "electric underfloor heating",
    "electric underfloor heating (standard tariff)": "electric underfloor heating",
    "electric ceiling heating": "electric ceiling heating",
    "community scheme": "community scheme",
    "community": "community",
    "community scheme utilising waste heat": "community",
    "cynllun cymunedol": "community",
    "hot-water-only systems": "hot-water-only systems",
    "warm air": "warm air",
    "air source heat pump": "air source heat pump",
    "air source heat pump, systems": "air source heat pump",
    "air source heat pump fan coil units": "air source heat pump",
    "air sourceheat pump": "air source heat pump",
    "mixed exhaust air source heat pump": "air source heat pump",
    "exhaust air mev source heat pump, , systems": "air source heat pump",
    "water source heat pump": "water source heat pump",
    "ground source heat pump": "ground source heat pump",
    "ground sourceheat pump": "ground source heat pump",
    "pwmp gwres sy’n tarddu yn y ddaear": "ground source heat pump",
    "community heat pump": "community heat pump",
    "warm air heat pump": "warm air heat pump",
    "heat pump": "heat pump",
    "electric heat pumps": "heat pump",
    "exhaust source heat pump": "heat pump",
    "heat pumptrydan": "heat pump",
    "solar assisted source heat pump": "solar assisted source heat pump",
    "solar-assisted heat pump": "solar assisted source heat pump",
    "solar assisted heat pump": "solar assisted source heat pump",
    "fully double glazed": UNKNOWN,
    "sap05:main-heating": UNKNOWN,
}

# Names of fuels as they are split from descriptions.
FUEL_NAMES = {
    "mains gas": "mains gas",
    "nwy prif gyflenwad": "mains gas",
    "gas": "mains gas",
    "heat from boilers - gas": "mains gas",
    "heat from boilers - mains gas": "mains gas",
    "balanced or open-flue, mains gas": "mains gas",
    "mains gas and mains gas": "mains gas",
    "bottled gas": "bottled gas",
    "unknown": UNKNOWN,
    "radiators": UNKNOWN,
    "community": UNKNOWN,
    "underfloor": UNKNOWN,
    "electric": "electric",
    "eletric": "electric",
    "electricaire": "electric",
    "electricity": "electric",
    "electricity (24-hr heating tariff)": "electric",
    "radiators, electric": "electric",
    "auxiliary heater (electric) source heat pump, radiators, electric": "electric",
    "electric storage heaters": "electric",
    "electric ceiling heating": "electric",
    "electric underfloor heating": "electric",
    "heat pump": "electric",
    "trydan": "electric",
    "oil": "oil",
    "olew": "oil",
    "lpg": "LPG",
    "bottled lpg": "LPG",
    "bulk lpg": "LPG",
    "lpg (bottleed)": "LPG",
    "lpg subject to special condition 18": "LPG",
    "dual fuel (mineral and wood)": "dual fuel (mineral and wood)",
    "dual fuel appliance": "dual fuel (mineral and wood)",
    "dual fuel appliance (mineral and wood)": "dual fuel (mineral and wood)",
    "coal": "coal",
    "glo": "coal",
    "house coal": "coal",
    "anthracite": "anthracite",
    "smokeless fuel": "smokeless fuel",
    "solid fuel": "solid fuel",
    "wood logs": "wood logs",
    "logiau coed": "wood logs",
    "wood chips": "wood chips",
    "wood pellets": "wood pellets",
    "main wood pellets": "wood pellets",
    "bulk wood pellets": "wood pellets",
    "biomass": "biomass",
    "bioethanol": "bio fuel",
    "b30k": "bio fuel",
    "liquid biofuel": "bio fuel",
    "geothermal heat": "geothermal heat",
    "waste heat": "waste heat",
    "chp": "Combined Heat and Power (CHP)",
    "chp, mains gas": "CHP / gas",
    "chp, radiators, mains gas": "CHP / mains gas",
    "chp, mains gas and oil": "CHP / mains gas / oil",
    "chp, biomass": "CHP / biomass",
    "chp, waste combustion and waste combustion": "CHP / waste",
    "chp, wood chips and mains gas": "CHP / wood chips / mains gas",
    "chp and electric": "CHP / electric",
    "chp and oil": "CHP / oil",
    "chp and geothermal": "CHP / geothermal",
    "biomass and mains gas": "biomass / mains gas",
    "mains gas and biomass": "biomass / mains gas",
    "biomass and oil": "biomass / oil",
    "geothermal heat and biomass": "geothermal heat / biomass",
    "wood pellets and mains gas": "mains gas / wood pellets",
    "mains gas and wood pellets": "mains gas / wood pellets",
    "wood chips and mains gas": "wood chips / mains gas",
    "waste heat, mains gas": "waste heat / mains gas",
    "oil and mains gas": "oil / mains gas",
}


def lookup(c: Column, mapping: dict, default=None) -> Column:
    """The mapped value; `default` for null and for anything that isn't a key."""
    found = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))[c]
    return found if default is None else F.coalesce(found, F.lit(default))


def strict_lookup(c: Column, mapping: dict, default: str) -> Column:
    """Like lookup, but a value that isn't null nor a key raises."""
    found = lookup(c, mapping)
    return F.when(c.isNull(), default).when(found.isNull(), F.raise_error(F.concat(F.lit("no category for "), c))).otherwise(found)
