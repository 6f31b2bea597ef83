import pytest

from retrofit_spark.sources import readers


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


@pytest.fixture()
def files(tmp_path):
    head = "BUILDING_REFERENCE_NUMBER,UPRN,POSTCODE,ADDRESS1\n"
    write(tmp_path / "ew/domestic-E1-York/certificates.csv", head + '1,10,YO1 1AA,"1 ""The"" St, York"\n2,,YO1 1AB,x\n')
    write(tmp_path / "ew/domestic-W2-Cardiff/certificates.csv", head + "3,30,CF1 1AA,y\n4,40,CF1 1AB,z\n")
    write(tmp_path / "ew/domestic-E1-York/recommendations.csv", "LMK_KEY,TEXT\nk,t\n")
    write(tmp_path / "sc/a.csv", "Postcode long,Building,Post town\nPOSTCODE,BUILDING_REFERENCE_NUMBER,POST_TOWN\nEH1 1AA,5,Caf\xe9\n", "iso-8859-1")
    for c in ("england", "wales", "scotland"):
        write(tmp_path / f"imd/{c}_imd.csv", f"IMD Rank,IMD Decile,Postcode,Income Score,Employment Score,extra\n1,2,{c},0.1,0.2,x\n")
    write(tmp_path / "pc.csv", "id,postcode,latitude,longitude\n1,AB1,57.1,-2.1\n")
    write(tmp_path / "mcs.csv", "date,tech_type,compressed_epc_address,address_1,address_2,postcode,# records\n2015-01-02,Air,k,1,,AB1,2\nbad,Air,k,,,AB1,1\n")
    write(tmp_path / "clean.csv", ",FINAL_HEATING_SYSTEM\n0,Heat pump\n1,Boiler\n")
    return tmp_path


def test_certificates(spark, files):
    names = ["POSTCODE", "BUILDING_REFERENCE_NUMBER", "POST_TOWN"]
    df = readers.read_certificates(spark, str(files / "ew"), str(files / "sc"), names)
    got = {r.BUILDING_REFERENCE_NUMBER: r for r in df.collect()}
    assert sorted(got) == ["1", "2", "3", "4", "5"] and got["2"].UPRN == "2" and got["1"].ADDRESS1 == '1 "The" St, York'
    assert got["5"].POSTTOWN == "Café" and [got[k].COUNTRY for k in "135"] == ["England", "Wales", "Scotland"]
    few = readers.read_england_wales(spark, str(files / "ew"), None, ["BUILDING_REFERENCE_NUMBER"], 1)
    assert sorted(r[0] for r in few.collect()) == ["1", "3"]
    assert readers.read_england_wales(spark, str(files / "ew"), "England", table="recommendations").columns == ["LMK_KEY", "TEXT", "COUNTRY"]
    with pytest.raises(ValueError):
        readers.read_certificates(spark, "", "", [], "Ireland")


def test_dimensions(spark, files):
    assert {r.IMD_COUNTRY for r in readers.read_deprivation(spark, str(files / "imd")).collect()} == {"England", "Wales", "Scotland"}
    assert tuple(readers.read_coordinates(spark, str(files / "pc.csv")).head()) == ("AB1", 57.1, -2.1)
    register = readers.read_register(spark, str(files / "mcs.csv")).collect()
    assert [str(r.date) for r in register] == ["2015-01-02", "None"] and register[0].address_2 == ""
    assert [r.HEAT_PUMP for r in readers.read_cleansed(spark, str(files / "clean.csv")).collect()] == [True, False]


def test_stages(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "a: b (c)")
    readers.write_stage(df, str(tmp_path), "raw", "s1")
    assert readers.read_stage(spark, str(tmp_path), "raw", "s1", n_rows=2).count() == 2
    with pytest.raises(ValueError):
        readers.stage_path("x", "other")
    units = spark.range(20).selectExpr("id", "concat('u', id % 5) AS POSTCODE_UNIT")
    assert readers.load_samples(spark, str(tmp_path), "5m", lambda: units, preload=False, least=6).count() == 8
    with pytest.raises(ValueError):
        readers.load_samples(spark, str(tmp_path), "all", lambda: units)
    for m in ("a", "b"):
        readers.write_predictions(df.limit(1), str(tmp_path), m)
    assert spark.read.parquet(str(tmp_path / "predictions")).count() == 2
