"""Certificate-like views over the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, features

EPC = """
SELECT o.o_orderkey AS building_reference_number,
 CASE WHEN o.o_custkey % 50 = 0 THEN NULL ELSE o.o_custkey END AS uprn,
 c.c_name AS address1,
 CASE WHEN o.o_custkey % 4 = 0 THEN NULL ELSE 'Flat ' || CAST(o.o_custkey % 9 AS STRING) END AS address2,
 CASE c.c_nationkey % 5 WHEN 0 THEN 'ab' WHEN 1 THEN 'YO' WHEN 2 THEN 'Cm' WHEN 3 THEN 'EH' ELSE 'SW' END
   || CAST(1 + c.c_nationkey % 9 AS STRING) || CASE WHEN o.o_custkey % 2 = 0 THEN '  ' ELSE ' ' END
   || CAST(o.o_custkey % 7 AS STRING) || CASE WHEN o.o_custkey % 3 = 0 THEN 'QW' ELSE 'xy' END AS postcode,
 CASE c.c_nationkey % 5 WHEN 3 THEN 'Scotland' WHEN 4 THEN 'Wales' ELSE 'England' END AS country,
 CASE WHEN o.o_orderkey % 97 = 0 THEN 'INVALID!'
      WHEN o.o_orderkey % 89 = 0 THEN '00' || SUBSTRING(CAST(CAST(o.o_orderdate AS DATE) AS STRING), 3, 8)
      ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS inspection_date_raw,
 CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS inspection_date,
 CASE o.o_orderkey % 8 WHEN 0 THEN 'owner-occupied' WHEN 1 THEN 'Owner-occupied' WHEN 2 THEN 'rental (social)'
   WHEN 3 THEN 'Rented (social)' WHEN 4 THEN 'Rented (private)' WHEN 5 THEN 'NO DATA!' WHEN 6 THEN NULL
   ELSE 'rental (private)' END AS tenure,
 CASE o.o_orderkey % 11 WHEN 0 THEN 'Air source heat pump, radiators, electric'
   WHEN 1 THEN 'Ground source heat pump, underfloor, electric' WHEN 2 THEN 'Boiler and radiators, mains gas'
   WHEN 3 THEN 'Boiler & underfloor heating, oil' WHEN 4 THEN 'Community scheme' WHEN 5 THEN 'Electric storage heaters'
   WHEN 6 THEN 'Room heaters, electric' WHEN 7 THEN 'Boiler and radiators, LPG | Room heaters, electric'
   WHEN 8 THEN NULL WHEN 9 THEN 'Pwmp gwres' ELSE 'Warm air, mains gas' END AS mainheat_description,
 CASE WHEN o.o_orderkey % 13 = 0 THEN 'Heat pump' WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE 'None' END AS secondheat_description,
 CASE o.o_orderkey % 9 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'D' WHEN 5 THEN 'E'
   WHEN 6 THEN 'F' WHEN 7 THEN 'G' ELSE 'INVALID!' END AS current_energy_rating,
 CASE o.o_orderkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS potential_energy_rating,
 CASE o.o_orderkey % 10 WHEN 0 THEN 'Very Good' WHEN 1 THEN ' poor |' WHEN 2 THEN '"Average"' WHEN 3 THEN 'N/A'
   WHEN 4 THEN 'NO DATA!' WHEN 5 THEN NULL WHEN 6 THEN 'Very Poor' ELSE 'Good' END AS windows_energy_eff,
 CASE o.o_orderkey % 6 WHEN 0 THEN 'Poor | Very Good | N/A' WHEN 1 THEN 'Good |' WHEN 2 THEN 'unknown'
   WHEN 3 THEN 'Very Poor | Poor | Poor | Good' WHEN 4 THEN NULL ELSE 'Average' END AS roof_energy_eff,
 CASE o.o_orderkey % 9 WHEN 0 THEN 'England and Wales: 1967-1975' WHEN 1 THEN '2015' WHEN 2 THEN '1984-1991'
   WHEN 3 THEN 'England and Wales: 2007-2011' WHEN 4 THEN 'before 1919' WHEN 5 THEN 'INVALID!' WHEN 6 THEN NULL
   WHEN 7 THEN ' 1950-1964 ' ELSE 'bogus' END AS construction_age_band,
 CASE o.o_orderkey % 7 WHEN 0 THEN 'Ground' WHEN 1 THEN '21st or above' WHEN 2 THEN '3.0' WHEN 3 THEN 'mid floor'
   WHEN 4 THEN 'NODATA!' WHEN 5 THEN NULL ELSE '02' END AS floor_level,
 CASE o.o_orderkey % 6 WHEN 0 THEN 'double, known data' WHEN 1 THEN 'single glazing' WHEN 2 THEN 'not defined'
   WHEN 3 THEN 'triple glazing' WHEN 4 THEN NULL ELSE 'secondary glazing' END AS glazed_type,
 CASE o.o_orderkey % 5 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Much More Than Typical' WHEN 2 THEN '2' WHEN 3 THEN 'Not Defined'
   ELSE NULL END AS glazed_area,
 CASE o.o_orderkey % 5 WHEN 0 THEN '50.0' WHEN 1 THEN '25%' WHEN 2 THEN 'Peak Power: 2.5 kW' WHEN 3 THEN '40' ELSE NULL END AS photo_supply,
 CASE o.o_orderkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN 'true' WHEN 3 THEN 'junk' ELSE NULL END AS solar_water_heating_flag,
 CASE WHEN o.o_orderkey % 19 = 0 THEN 'not recorded' WHEN o.o_orderkey % 23 = 0 THEN '-1'
   ELSE CAST(1 + o.o_orderkey % 14 AS STRING) END AS number_habitable_rooms,
 CASE WHEN o.o_orderkey % 31 = 0 THEN -1.0 ELSE o.o_totalprice / 1000.0 END AS total_floor_area,
 o.o_totalprice / 50000.0 AS co2_emissions_current,
 CASE o.o_custkey % 12 WHEN 0 THEN '00EM' ELSE 'LA ' || CAST(c.c_nationkey AS STRING) END AS local_authority_label
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

IMD = """
SELECT postcode AS "Postcode", MIN(uprn0) AS imd_rank, 1 + MIN(uprn0) % 10 AS imd_decile, COUNT(*) / 100.0 AS income_score
FROM (SELECT UPPER(REPLACE(postcode, ' ', '')) AS postcode, COALESCE(uprn, 0) AS uprn0 FROM epc) q
WHERE uprn0 % 6 <> 1 GROUP BY postcode
"""

MCS = """
SELECT CASE WHEN building_reference_number % 5 = 0 THEN NULL
  ELSE LOWER(REPLACE(address1 || COALESCE(address2, 'unknown') || postcode, ' ', '')) END AS compressed_epc_address,
 CAST(CAST(COALESCE(inspection_date, DATE '1999-01-01') + INTERVAL '200' DAY AS DATE) AS STRING) AS date_raw,
 address1 AS address_1, postcode AS postcode, building_reference_number % 3 AS version
FROM epc WHERE building_reference_number % 17 = 0
"""

COORDS = """
SELECT postcode, 50.0 + (ord % 90) / 10.0 AS latitude, -5.0 + (ord % 65) / 10.0 AS longitude
FROM (SELECT postcode, MIN(building_reference_number) AS ord FROM epc GROUP BY postcode) q
WHERE ord % 10 <> 3
"""

#: Postcodes without blanks and in capitals, their sector, the heat-pump flag, and a short key for the row.
BASE = r"""
SELECT *, building_reference_number AS brn, UPPER(regexp_replace(postcode, '\s+', '', 'g')) AS pc,
  left(UPPER(regexp_replace(postcode, '\s+', '', 'g')), length(regexp_replace(postcode, '\s+', '', 'g')) - 3) || ' '
    || left(right(UPPER(regexp_replace(postcode, '\s+', '', 'g')), 3), 1) AS sector,
  coalesce(contains(lower(mainheat_description), 'heat pump'), false) OR coalesce(contains(lower(secondheat_description), 'heat pump'), false)
    OR coalesce(contains(lower(mainheat_description), 'pwmp gwres'), false) OR coalesce(contains(lower(mainheat_description), 'pumpa teas'), false) AS hp
FROM epc
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EPC.replace("orders o", "{orders} o").replace("customer c ", "{customer} c "), orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def imd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(IMD.replace('"', "`").replace("FROM epc", "FROM {epc}"), epc=epc(spark, sf_dir))


def mcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MCS.replace("FROM epc", "FROM {epc}"), epc=epc(spark, sf_dir))


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COORDS.replace("FROM epc", "FROM {epc}"), epc=epc(spark, sf_dir))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = epc(spark, sf_dir)
    pc = clean.postcode(F.col("postcode"))
    hp = features.heating(F.col("mainheat_description"), F.col("secondheat_description"))["HP_INSTALLED"]
    return df.withColumns({"brn": F.col("building_reference_number"), "pc": pc, "sector": clean.postcode_level(pc, "sector"), "hp": hp})


def counted(sql: str) -> str:
    """count_if(x) spelled so that DuckDB gives a BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if('):end - 1]}){sql[end:]}"
    return sql


def oracle(select: str, *names: str) -> str:
    """A DuckDB query over the views named (each view's own needs included) and the given SELECT, which may start with further CTEs."""
    needs = {"epc": (), "imd": ("epc",), "mcs": ("epc",), "coords": ("epc",), "base": ("epc",)}
    text = {"epc": EPC, "imd": IMD, "mcs": MCS, "coords": COORDS, "base": BASE}
    order = list(dict.fromkeys(n for name in names or ("epc",) for n in (*needs[name], name)))
    ctes = ",\n".join(f"{n} AS ({text[n]})" for n in order)
    return f"WITH {ctes}{',' if select.lstrip().upper().startswith('WITH ') else ''}\n" + (select.lstrip()[5:] if select.lstrip().upper().startswith("WITH ") else select)


def case(expression: str, mapping: dict, default: str = "NULL") -> str:
    """A map as a CASE of SQL text."""
    quote = lambda v: "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {expression} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) + f" ELSE {default} END"
