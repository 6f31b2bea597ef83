"""Hand-written edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retrofit_spark.functions import clean, encode, features


def values(spark, expression, *inputs, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], f"k int, x {kind}")
    return [r.y for r in rows.select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()]


def test_dates(spark):
    got = values(spark, clean.standard_date, "0015-03-02", "INVALID!", "2016/01/31", "05/06/2015", "2015-13-01", None, "200012")
    assert got == [dt.date(2015, 3, 2), None, dt.date(2016, 1, 31), dt.date(2015, 6, 5), None, None, None]
    assert values(spark, lambda c: clean.standard_date(c, 2008, 2022), "2007-12-31", "2008-01-01", "2023-01-01") == [None, dt.date(2008, 1, 1), None]
    assert values(spark, clean.date_text, "0015-03-02", "2/3/2016", "2007-01-01", "", None, "16-1-1") == ["2015/03/02", "2016/3/2", "unknown", "unknown", "unknown", "unknown"]


def test_floor_level(spark):
    assert values(spark, clean.floor_level, "3.0", "20+", "abc", "Basement", "7th", "09", None) == [2, 10, None, -1, 7, 9, None]
    assert values(spark, lambda c: clean.floor_level(c, fix_quirks=True), "3.0") == [3]
    assert values(spark, lambda c: clean.floor_level(c, as_numeric=False), "20+", "abc", "1st") == ["10+", "unknown", "1"]


def test_age_band(spark):
    assert values(spark, lambda c: clean.age_band(c, merged=False), "England and Wales: 2007-2011", " 1919-1929 ", "2012", "x") == ["England and Wales: 2007 onwards", "Scotland: 1919-1929", "England and Wales: 2012 onwards", "unknown"]
    assert values(spark, clean.age_band, "England and Wales: 1967-1975", "1900", None) == ["1965-1975", "1900-1929", "unknown"]


def test_photo_supply(spark):
    assert values(spark, clean.photo_supply, "50", "50.0", "25%", "Peak Power: 2.5 kW", None) == [None, 50, 25, None, None]
    assert values(spark, lambda c: clean.photo_supply(c, fix_quirks=True), "50", "Peak Power: 5") == [50, None]


def test_unmapped(spark):
    assert values(spark, clean.tenure, "OWNER-occupied", "x", None) == ["owner-occupied", "unknown", "unknown"]
    with pytest.raises(Exception, match="no category"):
        values(spark, lambda c: clean.tenure(c, strict=True), "x")
    assert values(spark, clean.efficiency, '"Average"', " poor |", None) == ["Average", "Poor", "unknown"]


def test_numbers(spark):
    assert values(spark, clean.numeric, "3", "-1", "not recorded", "x", None) == [3, None, None, None, None]
    assert values(spark, lambda c: clean.numeric(c, negatives=True), "-1") == [-1]
    with pytest.raises(Exception):
        values(spark, lambda c: clean.numeric(c, strict=True), "x")
    assert values(spark, lambda c: clean.cap(c, 10), 12.0, 10.0, 9.5, None, kind="double") == [10, 10, 9.5, None]


def test_postcodes(spark):
    level = lambda n, **k: values(spark, lambda c: clean.postcode_level(c, n, **k), "YO30 5QW", "YO305QW", "QW")
    assert level("area") == ["YO", "YO", "QW"] and level("district") == ["YO30", "YO30", None]
    assert level("sector") == ["YO30 5", "YO30 5", None] and level("unit", with_space=False) == ["YO305QW", "YO305QW", None]
    with pytest.raises(ValueError):
        clean.postcode_level(F.col("x"), "street")


def test_building_id(spark):
    df = spark.createDataFrame([("1 High St", "YO305QW"), (None, "YO305QW")], "ADDRESS1 string, POSTCODE string")
    assert [r.BUILDING_ID for r in features.with_building_id(df).collect()] == [7550979495851836]


def test_heating(spark):
    rows = [("boiler and radiators, electric storage heaters", None), ("Boiler and radiators, mains gas", None), (None, None), ("Ground source heat pump, electric", None), ("Pwmp gwres", None), ("Room heaters, oil", "Heat pump")]
    df = features.with_heating(spark.createDataFrame(rows, "MAINHEAT_DESCRIPTION string, SECONDHEAT_DESCRIPTION string"))
    got = [(r.HEATING_SYSTEM, r.HEATING_FUEL, r.HP_INSTALLED, r.HP_TYPE) for r in df.collect()]
    assert got == [
        ("storage heater", "electric", False, "No HP"), ("boiler and radiator", "gas", False, "No HP"), ("unknown", "unknown", False, "No HP"),
        ("heat pump", "electric", True, "ground source heat pump"), ("unknown", "unknown", True, "No HP"), ("heater", "oil", True, "No HP"),
    ]
    fine = spark.createDataFrame(rows[3:4], "a string, b string").select(features.heating(F.col("a"), F.col("b"), True)["HEATING_SYSTEM"].alias("s"))
    assert fine.head().s == "ground source heat pump"


def test_efficiency_value(spark):
    assert values(spark, encode.efficiency_value, "Very Poor | Poor | Poor | Good", "N/A", None, "Good |", "Poor | Average") == [2.2, 0, 0, 4, 2.5]


def test_classes(spark):
    assert values(spark, features.mean_rating_class, 1.9, 2.0, 6.99, 7.0, None, kind="double") == ["F-G", "E-F", "A-B", None, None]
    assert values(spark, lambda c: features.mean_rating_class(c, fix_quirks=True), 7.0, kind="double") == ["A-B"]
    assert values(spark, features.heat_pump_share_class, 0.0, 0.5, 7.0, 7.1, kind="double") == ["0.0 %", "0.0 - 0.5 %", "5.0 % +", None]


def test_encoding(spark):
    df = spark.createDataFrame([(1, "a", "N"), (2, None, "Y"), (3, "false", "x")], "n int, f string, MAINS_GAS_FLAG string")
    out = encode.encode_features(df, ["MAINS_GAS_FLAG"], reduce=False)
    assert out.columns == ["n", "MAINS_GAS_FLAG", "f: a"] and [tuple(r) for r in out.orderBy("n").collect()] == [(1, 1, 1), (2, 3, 0), (3, None, 0)]
    with pytest.raises(ValueError):
        encode.encode_features(df, [], drop=["absent"])


def test_clean_certificates_passes_over_absent_columns(spark):
    df = spark.createDataFrame([("NO DATA!", "5", "x y")], "TENURE string, FLOOR_HEIGHT string, POSTCODE string")
    assert tuple(clean.clean_certificates(df).head()) == ("unknown", 5.0, "XY")
