"""Registered queries of the certificate library, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, encode, features
from ..functions import lookups as L
from ..operators import areas, entries, grid, installs, joins, metrics, ml, neighbours, profile, sampling, spatial
from ..operators.staging import new_path, staged
from . import jobs, training, views
from .views import base, case, coords, epc, imd, mcs, oracle, table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None, *names: str):
    """Registers a query under its function's name, with its oracle over the views named."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = views.counted(oracle(sql, *names) if names else sql)
        return f

    return add


c = F.col
BRN = "building_reference_number"

# ---------------------------------------------------------------- cleaning

_TOKENS = ", ".join(f"'{t}'" for t in L.SENTINELS)


def _known(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} IN ({_TOKENS}) THEN 'unknown' ELSE {x} END"


def _number(x: str) -> str:
    return f"(CASE WHEN {x} IN ({_TOKENS}) THEN NULL WHEN TRY_CAST({x} AS DOUBLE) >= 0 THEN TRY_CAST({x} AS DOUBLE) END)"


def _date(x: str) -> str:
    t = rf"regexp_replace({x}, '^00(\d\d)', '20\1')"
    return f"CAST(coalesce(try_strptime({t}, '%Y-%m-%d'), try_strptime({t}, '%Y/%m/%d'), try_strptime({t}, '%d/%m/%Y')) AS DATE)"


def _eff(x: str) -> str:
    return f"""trim(regexp_replace(trim(regexp_replace(trim(lower({x})), '^["]+|["]+$', '', 'g')), '^[|]+|[|]+$', '', 'g'))"""


_UNKNOWN = "'unknown'"
_FLOOR = case("floor_level", L.floor_levels())
_TENURE = case("lower(tenure)", L.TENURES, _UNKNOWN)
_MERGED = case("trim(construction_age_band)", L.age_bands(True), _UNKNOWN)
_ORIGINAL = case("trim(construction_age_band)", L.age_bands(False), _UNKNOWN)
_PHOTO = r"CASE WHEN NOT contains(photo_supply, 'Peak Power') THEN TRY_CAST(nullif(regexp_extract(photo_supply, '(\d+)[%\|.d$]', 1), '') AS DOUBLE) END"
_ROOMS = f"CASE WHEN {_number('number_habitable_rooms')} >= 10 THEN 10.0 ELSE {_number('number_habitable_rooms')} END"
_AUTHORITY = "CASE WHEN local_authority_label IN ('00EM', '16UD') THEN 'unknown' ELSE local_authority_label END"
_PC = r"upper(regexp_replace(postcode, '\s+', '', 'g'))"


@query(f"SELECT {BRN}, {_known('tenure')} AS tenure, {_known('current_energy_rating')} AS rating, {_known('glazed_type')} AS glazed_type, {_known('floor_level')} AS floor_level FROM epc", "epc")
def clean_sentinels(spark, d):
    own = {"tenure": "tenure", "current_energy_rating": "rating", "glazed_type": "glazed_type", "floor_level": "floor_level"}
    return epc(spark, d).select(BRN, *(clean.known_or_unknown(c(k)).alias(v) for k, v in own.items()))


@query(f"SELECT {BRN}, {_number('number_habitable_rooms')} AS rooms, {_number('CAST(total_floor_area AS VARCHAR)')} AS area FROM epc", "epc")
def clean_numeric(spark, d):
    return epc(spark, d).select(BRN, clean.numeric(c("number_habitable_rooms")).alias("rooms"), clean.numeric(c("total_floor_area")).alias("area"))


@query(f"SELECT {BRN}, {_date('inspection_date_raw')} AS inspected FROM epc", "epc")
def standardise_dates(spark, d):
    return epc(spark, d).select(BRN, clean.standard_date(c("inspection_date_raw")).alias("inspected"))


_DATE_TEXT = """CASE WHEN contains(x, '-') AND TRY_CAST(y AS INT) BETWEEN 1997 AND 2099 AND length(y) = 4
  THEN y || '/' || split_part(x, '-', 2) || '/' || split_part(x, '-', 3) ELSE 'unknown' END"""
_DATE_ROWS = f"(SELECT {BRN}, inspection_date_raw AS x, regexp_replace(split_part(inspection_date_raw, '-', 1), '^00', '20') AS y FROM epc) q"


@query(f"SELECT {BRN}, {_DATE_TEXT} AS inspected FROM {_DATE_ROWS}", "epc")
def date_formatter(spark, d):
    return epc(spark, d).select(BRN, clean.date_text(c("inspection_date_raw"), 1997, 2099).alias("inspected"))


@query(f"SELECT {BRN}, CASE WHEN t = 'unknown' THEN NULL ELSE CAST(left(t, 4) AS INT) END AS year, CASE WHEN t = 'unknown' THEN -1 ELSE CAST(replace(t, '/', '') AS INT) END AS day FROM (SELECT {BRN}, {_DATE_TEXT} AS t FROM {_DATE_ROWS}) r", "epc")
def date_features(spark, d):
    text = clean.date_text(c("inspection_date_raw"), 1997, 2099)
    return epc(spark, d).select(BRN, clean.year_of_text(text).alias("year"), clean.text_date_as_int(text).alias("day"))


@query(f"SELECT {BRN}, {case('solar_water_heating_flag', L.SOLAR_FLAGS, _UNKNOWN)} AS solar, {_AUTHORITY} AS authority FROM epc", "epc")
def clean_flags(spark, d):
    return epc(spark, d).select(BRN, clean.solar_flag(c("solar_water_heating_flag")).alias("solar"), clean.local_authority(c("local_authority_label")).alias("authority"))


@query(f"SELECT {BRN}, CAST({_FLOOR} AS DOUBLE) AS level, CASE WHEN {_FLOOR} = 10 THEN '10+' ELSE coalesce(CAST({_FLOOR} AS VARCHAR), 'unknown') END AS category FROM epc", "epc")
def clean_floor_level(spark, d):
    return epc(spark, d).select(BRN, clean.floor_level(c("floor_level")).alias("level"), clean.floor_level(c("floor_level"), as_numeric=False).alias("category"))


@query(f"SELECT {BRN}, {_TENURE} AS tenure FROM epc", "epc")
def clean_tenure(spark, d):
    return epc(spark, d).select(BRN, clean.tenure(c("tenure")).alias("tenure"))


@query(f"SELECT {BRN}, {_MERGED} AS merged, {_ORIGINAL} AS original FROM epc", "epc")
def clean_age_band(spark, d):
    return epc(spark, d).select(BRN, clean.age_band(c("construction_age_band")).alias("merged"), clean.age_band(c("construction_age_band"), merged=False).alias("original"))


@query(f"SELECT {BRN}, {case(_eff('windows_energy_eff'), L.EFFICIENCIES, _UNKNOWN)} AS windows, {case(_eff('roof_energy_eff'), L.EFFICIENCIES, _UNKNOWN)} AS roof FROM epc", "epc")
def clean_efficiency(spark, d):
    return epc(spark, d).select(BRN, clean.efficiency(c("windows_energy_eff")).alias("windows"), clean.efficiency(c("roof_energy_eff")).alias("roof"))


@query(f"SELECT {BRN}, CAST({case('glazed_area', L.GLAZED_AREAS)} AS DOUBLE) AS level, {case(case('glazed_area', L.GLAZED_AREAS), L.GLAZED_AREA_NAMES, _UNKNOWN)} AS category FROM epc", "epc")
def clean_glazed_area(spark, d):
    return epc(spark, d).select(BRN, clean.glazed_area(c("glazed_area")).alias("level"), clean.glazed_area(c("glazed_area"), as_numeric=False).alias("category"))


@query(f"SELECT {BRN}, {_PHOTO} AS share FROM epc", "epc")
def clean_photo_supply(spark, d):
    return epc(spark, d).select(BRN, clean.photo_supply(c("photo_supply")).alias("share"))


@query(f"SELECT {BRN}, {_ROOMS} AS rooms FROM epc", "epc")
def cap_values(spark, d):
    return epc(spark, d).select(BRN, clean.cap(clean.numeric(c("number_habitable_rooms")), 10).alias("rooms"))


@query(f"SELECT {BRN}, {_PC} AS postcode FROM epc", "epc")
def reformat_postcode(spark, d):
    return epc(spark, d).select(BRN, clean.postcode(c("postcode")).alias("postcode"))


_CLEAN = f"""SELECT {BRN}, {_known('address2')} AS address2, {_PC} AS postcode, {_date('inspection_date_raw')} AS inspection_date, {_TENURE} AS tenure,
  {_known('mainheat_description')} AS mainheat_description, {_known('current_energy_rating')} AS current_energy_rating,
  {case(_eff('windows_energy_eff'), L.EFFICIENCIES, _UNKNOWN)} AS windows_energy_eff, {_MERGED} AS construction_age_band,
  {_ORIGINAL} AS construction_age_band_original, CAST({_FLOOR} AS DOUBLE) AS floor_level, CAST({case('glazed_area', L.GLAZED_AREAS)} AS DOUBLE) AS glazed_area,
  {_PHOTO} AS photo_supply, {case('solar_water_heating_flag', L.SOLAR_FLAGS, _UNKNOWN)} AS solar_water_heating_flag, {_ROOMS} AS number_habitable_rooms,
  {_number('CAST(total_floor_area AS VARCHAR)')} AS total_floor_area, {_AUTHORITY} AS local_authority_label FROM epc"""


@query(_CLEAN, "epc")
def clean_epc(spark, d):
    out = clean.clean_certificates(epc(spark, d).drop("inspection_date").withColumnRenamed("inspection_date_raw", "inspection_date"))
    names = ("address2", "postcode", "inspection_date", "tenure", "mainheat_description", "current_energy_rating", "windows_energy_eff", "construction_age_band", "floor_level", "glazed_area", "photo_supply", "solar_water_heating_flag", "number_habitable_rooms", "total_floor_area", "local_authority_label")
    return out.select(c(BRN).cast("long").alias(BRN), *names, c("CONSTRUCTION_AGE_BAND_ORIGINAL").alias("construction_age_band_original"))


@query("SELECT brn, regexp_extract(pc, '([A-Z]+)', 1) AS area, left(pc, length(pc) - 3) AS district, sector, left(pc, length(pc) - 3) || ' ' || right(pc, 3) AS unit FROM base", "base")
def postcode_levels(spark, d):
    pc = clean.postcode(c("postcode"))
    return epc(spark, d).select(c(BRN).alias("brn"), *(clean.postcode_level(pc, level).alias(level) for level in clean.LEVELS))


# ---------------------------------------------------------------- features

_BUILDING = "CAST(substr(CAST(CAST(('0x' || md5(upper(address1) || upper({pc}))) AS UHUGEINT) AS VARCHAR), 1, 16) AS BIGINT)"


@query(f"SELECT {BRN}, upper(address1) || upper(postcode) AS unique_address, {_BUILDING.format(pc='postcode')} AS building_id FROM epc", "epc")
def building_id(spark, d):
    return features.with_building_id(epc(spark, d)).select(BRN, c("UNIQUE_ADDRESS").alias("unique_address"), c("BUILDING_ID").alias("building_id"))


_GAIN = f"({case('potential_energy_rating', L.RATING_NUMBERS)}) - ({case('current_energy_rating', L.RATING_NUMBERS)})"
_RATING = f"{case('current_energy_rating', L.RATING_NUMBERS)} AS number, {case('current_energy_rating', L.RATING_CLASSES)} AS class, CASE WHEN {_GAIN} BETWEEN 0 AND 7 THEN {_GAIN} END AS gain"


@query(f"SELECT {BRN}, CAST(number AS DOUBLE) AS number, class, CAST(gain AS DOUBLE) AS gain FROM (SELECT {BRN}, {_RATING} FROM epc) q", "epc")
def rating_features(spark, d):
    out = features.with_rating_features(epc(spark, d))
    return out.select(BRN, c("CURR_ENERGY_RATING_NUM").alias("number"), c("ENERGY_RATING_CAT").alias("class"), c("DIFF_POT_ENERGY_RATING").alias("gain"))


@query(f"SELECT {BRN}, CAST({case('windows_energy_eff', L.EFFICIENCY_SCORES)} AS DOUBLE) AS score FROM epc", "epc")
def quality_score(spark, d):
    return epc(spark, d).select(BRN, features.quality_score(c("windows_energy_eff")).alias("score"))


def _when(words: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{v}'" for w, v in words.items()) + f" ELSE {default} END"


_OTHER = dict(list(L.OTHER_SYSTEMS.items())[::-1])
_HEATING_ROWS = f"""(SELECT *, {_when({w: w for w in L.HEAT_PUMPS}, 'NULL')} AS pump, {_when(L.ELECTRIC_SYSTEMS, 'NULL')} AS electric, {_when(_OTHER, 'NULL')} AS other,
  {_when(dict(list(L.FUELS.items())[::-1]), _UNKNOWN)} AS fuel FROM (SELECT *, lower(mainheat_description) AS t FROM base) a) b"""
_HEATING = """CASE WHEN pump IS NOT NULL THEN 'heat pump' ELSE coalesce(electric, other, 'unknown') END AS system,
  CASE WHEN pump IS NOT NULL OR electric IS NOT NULL THEN 'electric' WHEN other IS NOT NULL THEN fuel ELSE 'unknown' END AS fuel,
  hp AS installed, coalesce(pump, 'No HP') AS type"""


@query(f"SELECT brn, {_HEATING} FROM {_HEATING_ROWS}", "base")
def heating_features(spark, d):
    out = features.with_heating(epc(spark, d))
    return out.select(c(BRN).alias("brn"), c("HEATING_SYSTEM").alias("system"), c("HEATING_FUEL").alias("fuel"), c("HP_INSTALLED").alias("installed"), c("HP_TYPE").alias("type"))


def _split_sql(text: str) -> tuple[str, str]:
    tidy = lambda x: f"coalesce(nullif(trim(lower({x})), ''), 'unknown')"
    word = "(.+)(with|utilising)(.+)"
    system = f"CASE WHEN contains({text}, ',') THEN split_part({text}, ',', 1) WHEN regexp_matches({text}, '{word}') THEN regexp_extract({text}, '{word}', 1) ELSE {text} END"
    fuel = f"CASE WHEN contains({text}, ',') THEN split_part({text}, ',', -1) WHEN regexp_matches({text}, '{word}') THEN regexp_extract({text}, '{word}', 3) ELSE 'unknown' END"
    return case(tidy(system), L.SYSTEM_NAMES | {"unknown": "unknown"}), case(tidy(fuel), L.FUEL_NAMES)


_FIRST, _SECOND = "coalesce(split_part(mainheat_description, '|', 1), '')", "coalesce(split_part(mainheat_description, '|', 2), '')"


@query(f"SELECT {BRN}, {_split_sql(_FIRST)[0]} AS first_system, {_split_sql(_FIRST)[1]} AS first_fuel, {_split_sql(_SECOND)[0]} AS second_system, {_split_sql(_SECOND)[1]} AS second_fuel FROM epc", "epc")
def heating_split(spark, d):
    parts = features.split_heating(c("mainheat_description"))
    return epc(spark, d).select(BRN, *(v.alias(k.lower().replace("_heating", "")) for k, v in parts.items()))


def _counted(key: str) -> str:
    n = f"count(*) OVER (PARTITION BY {key})"
    return f"CASE WHEN {key} IS NULL THEN NULL WHEN {n} >= 5 THEN '5.0+' ELSE CAST({n} AS VARCHAR) END"


@query(f"SELECT brn, {_counted('uprn')} AS n_uprn, {_counted('sector')} AS n_sector FROM base", "base")
def entry_counts(spark, d):
    return entries.with_entry_counts(base(spark, d), {"n_uprn": "uprn", "n_sector": "sector"}).select("brn", "n_uprn", "n_sector")


@query(f"""SELECT brn, building_id, {_counted('building_id')} AS n_building, {_counted('uprn')} AS n_uprn, {_HEATING}, CAST(number AS DOUBLE) AS number, class, CAST(gain AS DOUBLE) AS gain
FROM (SELECT *, {_BUILDING.format(pc='postcode')} AS building_id, {_RATING} FROM {_HEATING_ROWS}) q""", "base")
def additional_features(spark, d):
    out = features.with_additional_features(epc(spark, d), {"n_building": "BUILDING_ID", "n_uprn": "uprn"})
    names = {"HEATING_SYSTEM": "system", "HEATING_FUEL": "fuel", "HP_INSTALLED": "installed", "HP_TYPE": "type", "CURR_ENERGY_RATING_NUM": "number", "ENERGY_RATING_CAT": "class", "DIFF_POT_ENERGY_RATING": "gain", "BUILDING_ID": "building_id"}
    return out.select(c(BRN).alias("brn"), "n_building", "n_uprn", *(c(k).alias(v) for k, v in names.items()))


# ---------------------------------------------------------------- entries

_AT = {"date": "inspection_date", "tie": "brn"}


@query("SELECT brn, inspection_date FROM base WHERE year(inspection_date) <= 1998", "base")
def filter_by_year(spark, d):
    return entries.filter_by_year(base(spark, d), "uprn", 1998, date="inspection_date").select("brn", "inspection_date")


def _picked(order: str, where: str = "true") -> str:
    return f"SELECT uprn, brn, inspection_date, hp FROM (SELECT *, row_number() OVER (PARTITION BY uprn ORDER BY {order}) AS i FROM base WHERE {where}) q WHERE i = 1"


@query(_picked("inspection_date DESC NULLS FIRST, brn DESC"), "base")
def latest_entry(spark, d):
    return entries.pick_entry(base(spark, d), "uprn", "latest entry", **_AT).select("uprn", "brn", "inspection_date", "hp")


@query(_picked("inspection_date ASC NULLS LAST, brn ASC"), "base")
def first_entry(spark, d):
    return entries.pick_entry(base(spark, d), "uprn", "first entry", **_AT).select("uprn", "brn", "inspection_date", "hp")


@query("SELECT uprn, arg_min(hp, (epoch(inspection_date), brn)) AS at_first, arg_max(hp, (epoch(inspection_date), -brn)) AS at_last FROM base WHERE uprn IS NOT NULL AND inspection_date IS NOT NULL GROUP BY uprn", "base")
def first_last_state(spark, d):
    return entries.first_and_last_state(base(spark, d), "uprn", "hp", **_AT).select("uprn", c("AT_FIRST").alias("at_first"), c("AT_LAST").alias("at_last"))


_CHANGES = """SELECT uprn, brn, added FROM (SELECT *, count(*) OVER (PARTITION BY uprn) AS n, row_number() OVER (PARTITION BY uprn ORDER BY inspection_date ASC NULLS LAST, brn) AS i,
  first_value(hp) OVER (PARTITION BY uprn ORDER BY inspection_date DESC NULLS FIRST, brn DESC) AS added FROM base WHERE uprn IS NOT NULL) m WHERE n >= 2 AND i = 1 AND NOT hp"""


@query(_CHANGES, "base")
def status_changes(spark, d):
    return entries.status_changes(base(spark, d), "uprn", "hp", **_AT).select("uprn", "brn", c("HP_ADDED").alias("added"))


# ---------------------------------------------------------------- joins


@query("""SELECT brn, replace(base.postcode, ' ', '') AS postcode, imd_rank, imd_decile FROM base JOIN imd ON replace(base.postcode, ' ', '') = imd."Postcode" """, "imd", "base")
def imd_join(spark, d):
    return joins.join_deprivation(base(spark, d), imd(spark, d)).select("brn", "postcode", "imd_rank", "imd_decile")


@query(r"SELECT brn, pc AS postcode, round(CAST(latitude AS DOUBLE), 6) AS latitude, round(CAST(longitude AS DOUBLE), 6) AS longitude FROM base JOIN coords ON pc = upper(regexp_replace(coords.postcode, '\s+', '', 'g'))", "coords", "base")
def coords_join(spark, d):
    return joins.join_coordinates(base(spark, d), coords(spark, d)).select("brn", "postcode", F.round(c("latitude").cast("double"), 6).alias("latitude"), F.round(c("longitude").cast("double"), 6).alias("longitude"))


_REGISTER = """r AS (SELECT compressed_epc_address AS k, min(CAST(date_raw AS DATE)) AS install_date, arg_min(version, (date_raw, version)) AS version
  FROM mcs WHERE compressed_epc_address IS NOT NULL GROUP BY 1)"""
_KEY = r"lower(regexp_replace(address1 || coalesce(address2, 'unknown') || postcode, '\s+', '', 'g'))"


def _register(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    register = mcs(spark, d).withColumn("day", F.try_to_date("date_raw", "yyyy-MM-dd"))
    key = joins.address_key(c("address1"), F.coalesce(c("address2"), F.lit("unknown")), c("postcode"))
    return joins.join_installations(df, register, key, date="day", values={"version": "version"}, tie="version")


@query(f"WITH {_REGISTER} SELECT brn, install_date, r.version AS version FROM base LEFT JOIN r ON {_KEY} = k", "mcs", "base")
def mcs_left_join(spark, d):
    return _register(base(spark, d), spark, d).select("brn", c("HP_INSTALL_DATE").alias("install_date"), "version")


@query("SELECT brn, country, CASE WHEN country <> 'Scotland' THEN tenure END AS tenure, CASE WHEN country <> 'Wales' THEN glazed_type END AS glazed_type FROM base", "base")
def union_countries(spark, d):
    df = base(spark, d).select("brn", "country", "tenure", "glazed_type")
    lacking = {"England": [], "Scotland": ["tenure"], "Wales": ["glazed_type"]}
    return joins.union_tables([df.where(c("country") == k).drop(*v) for k, v in lacking.items()])


# ---------------------------------------------------------------- installations

_DATED = f"""{_REGISTER},
dated AS (SELECT brn, uprn, inspection_date, hp, install_date FROM base LEFT JOIN r ON {_KEY} = k WHERE inspection_date IS NOT NULL),
facts AS (SELECT *, CASE WHEN uprn IS NOT NULL THEN min(CASE WHEN hp THEN inspection_date END) OVER w END AS mention,
  CASE WHEN uprn IS NOT NULL THEN first_value(hp) OVER (PARTITION BY uprn ORDER BY inspection_date, brn) END AS hp_first,
  CASE WHEN uprn IS NOT NULL THEN first_value(hp) OVER (PARTITION BY uprn ORDER BY inspection_date DESC, brn) END AS hp_last,
  install_date IS NOT NULL AS mcs, coalesce(inspection_date < install_date, false) AS before FROM dated WINDOW w AS (PARTITION BY uprn)),
flags AS (SELECT *, mcs AND hp AND before AS flag_before, mcs AND NOT hp AND NOT before AS flag_after, mcs AND NOT hp AND before AS erase,
  hp_first AND NOT hp_last AS lost, NOT hp_first AND hp_last AS added, NOT hp_first AND NOT hp_last AND mention IS NOT NULL AS middle FROM facts)"""


def _dated(spark, d) -> DataFrame:
    return _register(base(spark, d), spark, d).select("brn", "uprn", "inspection_date", "hp", c("HP_INSTALL_DATE").alias("install_date"))


@query(f"""WITH {_DATED}
SELECT brn, uprn, inspection_date, hp, CASE WHEN erase THEN NULL WHEN NOT mcs AND hp THEN mention ELSE install_date END AS install_date, mention, mcs,
  mention IS NOT NULL AS some, false AS dup, lost, added, middle, flag_before, flag_after FROM flags
UNION ALL
SELECT brn, uprn, install_date, true, install_date, mention, mcs, true, true, lost, added, middle, flag_before, flag_after FROM flags WHERE erase AND mention IS NULL""", "mcs", "base")
def install_dates(spark, d):
    out = installs.reconcile_install_dates(_dated(spark, d), "uprn", "inspection_date", "hp", "install_date", "brn")
    names = {"FIRST_HP_MENTION": "mention", "MCS_AVAILABLE": "mcs", "HAS_HP_AT_SOME_POINT": "some", "ARTIFICIALLY_DUPL": "dup", "HP_LOST": "lost", "HP_ADDED": "added", "HP_IN_THE_MIDDLE": "middle", installs.BEFORE: "flag_before", installs.AFTER: "flag_after"}
    return out.select("brn", "uprn", "inspection_date", "hp", "install_date", *(c(f"`{k}`").alias(v) for k, v in names.items()))


@query(f"""WITH {_DATED}
SELECT count(*) AS total, count_if(mcs OR hp) AS either, count_if(mcs AND hp) AS mcs_and_hp, count_if(mcs AND NOT hp) AS mcs_no_hp, count_if(NOT mcs AND hp) AS no_mcs_hp,
  count_if(mcs AND hp AND before) AS mcs_hp_before, count_if(mcs AND hp AND NOT before) AS mcs_hp_after, count_if(mcs AND NOT hp AND before) AS mcs_no_hp_before,
  count_if(mcs AND NOT hp AND NOT before) AS mcs_no_hp_after, count_if(mcs AND NOT hp AND before AND mention IS NULL) AS mcs_no_hp_before_never FROM flags""", "mcs", "base")
def install_audit(spark, d):
    df = _dated(spark, d).where("inspection_date IS NOT NULL")
    some = df.where("uprn IS NOT NULL AND hp").select(c("uprn").alias("k")).distinct()
    marked = df.join(some, c("uprn") == c("k"), "left").withColumn("some", c("k").isNotNull())
    return installs.install_audit(marked, "hp", "inspection_date", "install_date", "some")


@query(f"WITH {_DATED} SELECT flag_after AS after, count(*) AS n, count_if(date_diff('day', install_date, inspection_date) > 365) AS n_more FROM flags WHERE install_date IS NOT NULL GROUP BY 1", "mcs", "base")
def date_gap_audit(spark, d):
    out = installs.reconcile_install_dates(_dated(spark, d).withColumn("registered", c("install_date")), "uprn", "inspection_date", "hp", "install_date", "brn")
    originals = out.where(~c("ARTIFICIALLY_DUPL")).withColumn("after", c(f"`{installs.AFTER}`"))
    return installs.gap_audit(originals, "after", "inspection_date", "registered")


# ---------------------------------------------------------------- areas

_CATS = ["tenure", "glazed_type", "current_energy_rating"]
_LONG = "UNION ALL ".join(f"SELECT sector, '{f}' AS feature, {f} AS category FROM base WHERE {f} IS NOT NULL " for f in _CATS)
_TENURE_VALUES = {"tenure": ["owner-occupied", "rental (private)", "rental (social)", "unknown"]}
_TENURES = f"(SELECT * EXCLUDE (tenure), {_TENURE} AS tenure FROM base)"


@query("SELECT sector, count(*) AS n FROM base GROUP BY sector", "base")
def area_size(spark, d):
    return areas.group_size(base(spark, d), "sector")


@query(f"SELECT sector, feature, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY sector, feature), 6) AS share FROM ({_LONG}) q GROUP BY sector, feature, category", "base")
def category_share_long(spark, d):
    return metrics.rounded(areas.category_shares(base(spark, d), "sector", _CATS), ["share"], 6)


def _mode(feature: str) -> str:
    return f"(SELECT sector, {feature} AS v FROM (SELECT sector, {feature}, row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, {feature}) AS i FROM base WHERE {feature} IS NOT NULL GROUP BY sector, {feature}) q WHERE i = 1)"


@query("WITH k AS " + _TENURES + " SELECT sector, count(tenure) AS sector_TOTAL, " + ", ".join(f"""round(count_if(tenure = '{v}') / nullif(count(tenure), 0), 6) AS "tenure: {v}" """ for v in _TENURE_VALUES["tenure"]) + ", any_value(v) AS MOST_FREQUENT_tenure FROM k LEFT JOIN " + _mode("tenure").replace("FROM base", "FROM k") + " m USING (sector) GROUP BY sector", "base")
def category_share_wide(spark, d):
    out = areas.category_shares_wide(base(spark, d).withColumn("tenure", clean.tenure(c("tenure"))), "sector", ["tenure"], _TENURE_VALUES)
    return metrics.rounded(out, [x for x in out.columns if x.startswith("tenure: ")], 6)


@query(f"SELECT sector, v AS MOST_FREQUENT_glazed_type FROM {_mode('glazed_type')} m", "base")
def most_frequent(spark, d):
    return areas.most_frequent(base(spark, d), "sector", "glazed_type")


@query("SELECT sector, count_if(tenure = 'owner-occupied') AS n FROM base WHERE tenure IS NOT NULL GROUP BY sector", "base")
def value_count(spark, d):
    return areas.value_count(base(spark, d), "sector", "tenure", "owner-occupied", "n")


@query("SELECT sector, round(median(total_floor_area), 6) AS total_floor_area, round(median(co2_emissions_current), 6) AS co2_emissions_current FROM base GROUP BY sector", "base")
def median_numeric(spark, d):
    names = ["total_floor_area", "co2_emissions_current"]
    return metrics.rounded(areas.medians(base(spark, d), "sector", names), names, 6)


_GLAZED = {"glazed_type": ["double, known data", "not defined", "secondary glazing", "single glazing", "triple glazing"]}
_AREA_COLUMNS = ["total_floor_area", "co2_emissions_current"]
_AREA_SQL = "round(median(total_floor_area), 6) AS total_floor_area, round(median(co2_emissions_current), 6) AS co2_emissions_current, count(glazed_type) AS sector_TOTAL, " + ", ".join(
    f"""round(count_if(glazed_type = '{v}') / nullif(count(glazed_type), 0), 6) AS "glazed_type: {v}", CAST(coalesce(any_value(v) = '{v}', false) AS INT) AS "MOST_FREQUENT_glazed_type: {v}" """ for v in _GLAZED["glazed_type"]
)


def _area_frame(spark, d) -> DataFrame:
    return base(spark, d).select("sector", "glazed_type", "current_energy_rating", *_AREA_COLUMNS)


def _rounded_area(out: DataFrame) -> DataFrame:
    return metrics.rounded(out, [x for x in out.columns if x in _AREA_COLUMNS or x.startswith("glazed_type: ")], 6)


@query(f"SELECT sector, {_AREA_SQL} FROM base LEFT JOIN {_mode('glazed_type')} m USING (sector) GROUP BY sector", "base")
def area_features(spark, d):
    return _rounded_area(areas.area_features(_area_frame(spark, d), "sector", ordinal=["current_energy_rating"], values=_GLAZED))


def _latest_by(year: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uprn ORDER BY inspection_date DESC, brn DESC) AS i FROM base WHERE uprn IS NOT NULL AND inspection_date < DATE '{year + 1}-01-01') q WHERE i = 1)"


_ALL = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uprn ORDER BY inspection_date DESC NULLS FIRST, brn DESC) AS i FROM base WHERE uprn IS NOT NULL) q WHERE i = 1)"


def _growth_sql(base_column: str) -> str:
    return f"""SELECT s.sector AS sector, round(s.h / nullif({base_column}, 0), 6) AS now, round(t.h / nullif({base_column}, 0), 6) AS later, round(t.h / nullif({base_column}, 0) - s.h / nullif({base_column}, 0), 6) AS growth
FROM (SELECT sector, count_if(hp) AS h FROM {_latest_by(1997)} GROUP BY sector) s JOIN (SELECT sector, count_if(hp) AS h, count(*) AS n FROM {_latest_by(1999)} GROUP BY sector) t USING (sector)
JOIN (SELECT sector, count(*) AS n, count_if(hp) AS h FROM {_ALL} GROUP BY sector) a USING (sector)"""


def _growth(spark, d, by: str) -> DataFrame:
    out = areas.growth(base(spark, d), "sector", 1997, 1999, by, "uprn", "hp", "inspection_date", "brn")
    return out.select("sector", *(F.round(c(k), 6).alias(v) for k, v in (("HP_COVERAGE_CURRENT", "now"), ("HP_COVERAGE_FUTURE", "later"), ("GROWTH", "growth"))))


@query(_growth_sql("a.n"), "base")
def hp_growth(spark, d):
    return _growth(spark, d, "total")


@query(_growth_sql("t.n"), "base")
def hp_growth_target_norm(spark, d):
    return _growth(spark, d, "target")


@query(_growth_sql("a.h"), "base")
def hp_growth_hp_norm(spark, d):
    return _growth(spark, d, "total HPs")


@query(f"WITH g AS ({_growth_sql('a.n')}) SELECT brn, sector FROM base WHERE sector IN (SELECT sector FROM g WHERE growth >= 0)", "base")
def growth_nonnegative(spark, d):
    return joins.only_in(base(spark, d).select("brn", "sector"), _growth(spark, d, "total").where("growth >= 0"), "sector")


@query(f"""WITH g AS ({_growth_sql('a.n')}), src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uprn ORDER BY inspection_date DESC, brn DESC) AS i FROM base WHERE inspection_date < DATE '1998-01-01') q WHERE i = 1)
SELECT f.*, g.now, g.later, g.growth FROM (SELECT sector, {_AREA_SQL} FROM src LEFT JOIN {_mode('glazed_type').replace('FROM base', 'FROM src')} m USING (sector) GROUP BY sector) f JOIN g USING (sector) WHERE g.growth >= 0""", "base")
def area_training_table(spark, d):
    df = base(spark, d).select("sector", "glazed_type", "current_energy_rating", *_AREA_COLUMNS, "uprn", "hp", "inspection_date", "brn")
    out = areas.area_training_table(df, "sector", 1997, 1999, ordinal=["current_energy_rating", "hp"], values=_GLAZED, key="uprn", installed="hp", date="inspection_date", tie="brn")
    out = _rounded_area(out)
    return out.select(*(x for x in out.columns if not x.isupper()), *(F.round(c(k), 6).alias(v) for k, v in (("HP_COVERAGE_CURRENT", "now"), ("HP_COVERAGE_FUTURE", "later"), ("GROWTH", "growth"))))


@query(f"WITH g AS ({_growth_sql('a.n')}) SELECT round(avg(CAST(now = 0 AS DOUBLE)), 6) AS share FROM g", "base")
def zero_coverage_share(spark, d):
    return metrics.rounded(metrics.share_of(_growth(spark, d, "total"), c("now") == 0), ["share"], 6)


# ---------------------------------------------------------------- encoding


def _reduced(x: str, feature: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'unknown' ELSE {case(x, L.REDUCTIONS[feature])} END"


@query(f"SELECT {BRN}, {_reduced('glazed_type', 'GLAZED_TYPE')} AS glazed_type FROM epc", "epc")
def reduce_categories(spark, d):
    return encode.reduce_categories(epc(spark, d)).select(BRN, "glazed_type")


_SCORES = case("trim(p)", L.EFFICIENCY_SCORES)


def _eff_value(x: str) -> str:
    parts = f"list_filter(list_transform(string_split({x}, '|'), lambda p: trim(p)), lambda p: p NOT IN ('N/A', 'unknown', ''))"
    return f"coalesce(round_even(list_avg(list_transform({parts}, lambda p: {_SCORES})), 1), 0.0)"


@query(f"SELECT {BRN}, {_eff_value('roof_energy_eff')} AS roof FROM epc", "epc")
def encode_efficiency(spark, d):
    return epc(spark, d).select(BRN, encode.efficiency_value(c("roof_energy_eff")).alias("roof"))


def _ordinal(x: str, order: list) -> str:
    return case(x, {v: k for k, v in enumerate(order, 1)})


@query(f"SELECT {BRN}, {_ordinal('current_energy_rating', L.ORDERS['CURRENT_ENERGY_RATING'])} AS current_energy_rating, {_ordinal('glazed_type', L.ORDERS['GLAZED_TYPE'])} AS glazed_type, {_eff_value('roof_energy_eff')} AS roof_energy_eff FROM epc", "epc")
def encode_ordinal(spark, d):
    names = ["CURRENT_ENERGY_RATING", "GLAZED_TYPE", "ROOF_ENERGY_EFF", "N_ENTRIES"]
    return encode.encode_ordinal(epc(spark, d), names).select(BRN, "current_energy_rating", "glazed_type", "roof_energy_eff")


@query(f"SELECT {BRN}, " + ", ".join(f"""CAST(coalesce(glazed_type = '{v}', false) AS INT) AS "glazed_type: {v}" """ for v in _GLAZED["glazed_type"]) + " FROM epc", "epc")
def one_hot(spark, d):
    return encode.one_hot(epc(spark, d).select(BRN, "glazed_type"), ["glazed_type"])


_COUNTRIES = ["England", "Scotland", "Wales"]


@query(f"SELECT {BRN}, {_ordinal('g', L.ORDERS['GLAZED_TYPE'])} AS glazed_type, total_floor_area, uprn, " + ", ".join(f"""CAST(country = '{v}' AS INT) AS "country: {v}" """ for v in _COUNTRIES) + f" FROM (SELECT *, {_reduced('glazed_type', 'GLAZED_TYPE')} AS g FROM epc) q", "epc")
def encode_pipeline(spark, d):
    df = epc(spark, d).select(BRN, "glazed_type", "country", "total_floor_area", "uprn", "address1")
    return encode.encode_features(df, ["GLAZED_TYPE"], unaltered=["uprn"], drop=["address1"])


_HOUSEHOLD = ["UPRN", "POSTCODE", "ADDRESS1", "ADDRESS2", "COUNTRY", "MAINHEAT_DESCRIPTION", "CURRENT_ENERGY_RATING", "POTENTIAL_ENERGY_RATING", "ROOF_ENERGY_EFF", "GLAZED_TYPE", "CONSTRUCTION_AGE_BAND", "INSPECTION_DATE", "TOTAL_FLOOR_AREA"]


@query(f"""SELECT uprn AS UPRN, postcode AS POSTCODE, {_ordinal('current_energy_rating', L.ORDERS['CURRENT_ENERGY_RATING'])} AS CURRENT_ENERGY_RATING, {_ordinal('potential_energy_rating', L.ORDERS['POTENTIAL_ENERGY_RATING'])} AS POTENTIAL_ENERGY_RATING,
{_eff_value('roof_energy_eff')} AS ROOF_ENERGY_EFF, {_ordinal('g', L.ORDERS['GLAZED_TYPE'])} AS GLAZED_TYPE, inspection_date AS INSPECTION_DATE, total_floor_area AS TOTAL_FLOOR_AREA, hp AS HP_INSTALLED, {_ordinal('same', L.ORDERS['N_SAME_UPRN_ENTRIES'])} AS N_SAME_UPRN_ENTRIES,
""" + ", ".join(f"""CAST(country = '{v}' AS INT) AS "COUNTRY: {v}" """ for v in _COUNTRIES) + f"FROM (SELECT *, {_reduced('glazed_type', 'GLAZED_TYPE')} AS g, {_counted('uprn')} AS same FROM base) q", "base")
def encode_households(spark, d):
    df = base(spark, d).select(*(c(x.lower()).alias(x) for x in _HOUSEHOLD), c("brn").alias("BUILDING_REFERENCE_NUMBER"), c("hp").alias("HP_INSTALLED"))
    out = jobs.household_encoding(entries.with_entry_counts(df, {"N_SAME_UPRN_ENTRIES": "UPRN"}))
    return out.withColumn("ROOF_ENERGY_EFF", c("ROOF_ENERGY_EFF").cast("double"))


# ---------------------------------------------------------------- sampling


@query("""WITH s AS (SELECT sector, count(*) AS n FROM base GROUP BY sector), o AS (SELECT *, sum(n) OVER (ORDER BY md5(sector || '42'), sector) - n AS earlier FROM s)
SELECT brn, sector FROM base WHERE sector IN (SELECT sector FROM o WHERE earlier < 2000)""", "base")
def complete_area_sample(spark, d):
    return sampling.complete_groups(base(spark, d), "sector", 2000).select("brn", "sector")


_BALANCED = """b AS (SELECT brn, pump FROM (SELECT brn, pump, row_number() OVER (PARTITION BY pump ORDER BY md5(CAST(brn AS VARCHAR) || '42'), brn) AS i, count_if(pump) OVER () AS yes FROM {rows}) q
  WHERE pump OR i <= CAST(trunc(yes * (0.8::DOUBLE / (1 - 0.8::DOUBLE))) AS BIGINT))"""
_PUMPS = "(SELECT brn, {hp} AS pump FROM {src} z)"


@query("WITH " + _BALANCED.format(rows=_PUMPS.format(hp="hp", src="base")) + " SELECT brn, pump FROM b", "base")
def balance_set(spark, d):
    return sampling.balance(base(spark, d).select("brn", c("hp").alias("pump")), "pump", "brn")


@query("SELECT brn, hp, i > ceil(n * 0.1) AS training FROM (SELECT brn, hp, count(*) OVER (PARTITION BY hp) AS n, row_number() OVER (PARTITION BY hp ORDER BY md5(CAST(brn AS VARCHAR) || '42'), brn) AS i FROM base) q", "base")
def train_test_split(spark, d):
    return sampling.split(base(spark, d).select("brn", "hp"), "brn", 0.1, "hp", name="training")


@query("WITH l AS (" + _picked("inspection_date DESC NULLS FIRST, brn DESC") + "), " + _BALANCED.format(rows=_PUMPS.format(hp="hp", src="l")) + " SELECT brn, pump FROM b", "base")
def labelled_current_status(spark, d):
    df = base(spark, d).withColumn("HP_INSTALLED", c("hp"))
    rows, targets = jobs.labelled(df, "Current HP Status", key="uprn", tie="brn", balanced=True)
    return rows.select("brn", c(targets[0]).alias("pump"))


@query(f"WITH l AS (SELECT brn, added FROM ({_CHANGES}) w), " + _BALANCED.format(rows=_PUMPS.format(hp="added", src="l")) + " SELECT brn, pump FROM b", "base")
def labelled_future_status(spark, d):
    df = base(spark, d).withColumn("HP_INSTALLED", c("hp"))
    rows, targets = jobs.labelled(df, "Future HP Status", key="uprn", tie="brn", balanced=True)
    return rows.select("brn", c(targets[0]).alias("pump"))


@query(f"WITH g AS ({_growth_sql('a.n')}) SELECT sector, later, growth FROM g WHERE growth >= 0", "base")
def labelled_growth(spark, d):
    df = base(spark, d).select("sector", "glazed_type", "current_energy_rating", *_AREA_COLUMNS, "uprn", "hp", "inspection_date", "brn")
    areas_of = jobs.growth_by_area(df, "sector", 1997, 1999, ordinal=["current_energy_rating", "hp"], values=_GLAZED, key="uprn", installed="hp", date="inspection_date", tie="brn")
    rows, targets = jobs.labelled(areas_of, "HP Growth by Area", drop=("HP_COVERAGE_CURRENT",))
    return rows.select("sector", *(F.round(c(t), 6).alias(v) for t, v in zip(targets, ("growth", "later"), strict=True)))


# ---------------------------------------------------------------- grid

_CELL = """cells AS (SELECT b.*, x.cell FROM base b JOIN (SELECT postcode, CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END::BIGINT || ':' || CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END::BIGINT AS cell
  FROM (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(s + 0.5) AS rs
  FROM (SELECT *, -q - r AS s FROM (SELECT postcode, (0.5773502691896257::DOUBLE * x - y / 3) / 7.5::DOUBLE AS q, (2.0::DOUBLE / 3 * y) / 7.5::DOUBLE AS r
  FROM (SELECT postcode, CAST(longitude AS DOUBLE) * 111.32::DOUBLE * cos(radians(54)) AS x, CAST(latitude AS DOUBLE) * 110.57::DOUBLE AS y FROM coords) a) b) c) e) f) x ON x.postcode = b.postcode)"""


def _cells(spark, d) -> DataFrame:
    right = coords(spark, d).withColumns({"latitude": c("latitude").cast("double"), "longitude": c("longitude").cast("double")})
    return grid.with_cell(base(spark, d).join(right, "postcode"), "latitude", "longitude", name="cell")


@query(f"WITH {_CELL} SELECT brn, cell FROM cells", "coords", "base")
def grid_cell(spark, d):
    return _cells(spark, d).select("brn", "cell")


_HEX = f"sum(coalesce({case('current_energy_rating', L.RATING_NUMBERS)}, 0)) / nullif(count(current_energy_rating), 0)"
_HEX_CLASS = "CASE WHEN x < 2 THEN 'F-G' WHEN x < 3 THEN 'E-F' WHEN x < 4 THEN 'D-E' WHEN x < 5 THEN 'C-D' WHEN x < 6 THEN 'B-C' WHEN x < 7 THEN 'A-B' END"
_HP_CLASS = "CASE WHEN p <= 0 THEN '0.0 %' WHEN p <= 0.5 THEN '0.0 - 0.5 %' WHEN p <= 2 THEN '0.5 - 2.0 %' WHEN p <= 5 THEN '2.0 - 5.0 %' WHEN p <= 7 THEN '5.0 % +' END"


def _cell_mode(feature: str) -> str:
    return f"(SELECT cell, v FROM (SELECT cell, {feature} AS v, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, {feature}) AS i FROM cells WHERE {feature} IS NOT NULL GROUP BY cell, {feature}) q WHERE i = 1)"


@query(f"""WITH {_CELL} SELECT cell, density, round(x, 6) AS rating, {_HEX_CLASS} AS rating_class, r.v AS top_rating, round(p, 6) AS hp_perc, {_HP_CLASS} AS hp_class, h.v AS top_hp, round(co2, 6) AS co2
FROM (SELECT cell, count(current_energy_rating) AS density, {_HEX} AS x, avg(CAST(hp AS INT)) * 100 AS p, avg(co2_emissions_current) AS co2 FROM cells GROUP BY cell) a
LEFT JOIN {_cell_mode('current_energy_rating')} r USING (cell) LEFT JOIN {_cell_mode('hp')} h USING (cell)""", "coords", "base")
def grid_features(spark, d):
    out = grid.cell_features(_cells(spark, d), "cell", "current_energy_rating", "hp")
    return out.select("cell", "density", F.round("HEX_RATING", 6).alias("rating"), c("EPC_CAT").alias("rating_class"), c("MOST_FREQUENT_CURRENT_ENERGY_RATING").alias("top_rating"), F.round("HP_PERC", 6).alias("hp_perc"), c("HP_CAT").alias("hp_class"), c("MOST_FREQUENT_HP_INSTALLED").alias("top_hp"), F.round("CO2_EMISSIONS_CURRENT", 6).alias("co2"))


@query(f"WITH {_CELL} SELECT cell, v AS authority FROM {_cell_mode('local_authority_label')} m", "coords", "base")
def grid_mode(spark, d):
    return grid.cell_mode(_cells(spark, d), "local_authority_label", "cell").select("cell", c("MOST_FREQUENT_local_authority_label").alias("authority"))


@query(f"WITH {_CELL} SELECT cell, round(avg(CAST(hp AS INT)) * 100, 6) AS heat_pump_perc, count(hp) AS density FROM cells GROUP BY cell", "coords", "base")
def grid_uptake(spark, d):
    return metrics.rounded(grid.cell_uptake(_cells(spark, d), "cell", "hp"), ["heat_pump_perc"], 6)


@query(f"WITH {_CELL} SELECT cell, total, round(x, 6) AS rating, {_HEX_CLASS} AS rating_class, round(share_a, 6) AS share_a, round(share_g, 6) AS share_g FROM (SELECT cell, count(current_energy_rating) AS total, {_HEX} AS x, count_if(current_energy_rating = 'A') / nullif(count(current_energy_rating), 0) AS share_a, count_if(current_energy_rating = 'G') / nullif(count(current_energy_rating), 0) AS share_g FROM cells GROUP BY cell) q", "coords", "base")
def grid_rating(spark, d):
    out = grid.cell_ratings(_cells(spark, d), "cell", "current_energy_rating")
    return out.select("cell", "total", F.round("HEX_RATING", 6).alias("rating"), c("EPC_CAT").alias("rating_class"), F.round("A", 6).alias("share_a"), F.round("G", 6).alias("share_g"))


# ---------------------------------------------------------------- profiles


@query("SELECT tenure AS value, count(*) AS n FROM base GROUP BY tenure", "base")
def value_profile(spark, d):
    return profile.value_profile(base(spark, d), "tenure")


@query("SELECT 'tenure' AS column_name, count(tenure) = 0 AS all_null FROM epc UNION ALL SELECT 'nothing', true UNION ALL SELECT 'uprn', count(uprn) = 0 FROM epc", "epc")
def all_null_columns(spark, d):
    return profile.null_columns(epc(spark, d).select("tenure", F.lit(None).cast("string").alias("nothing"), "uprn"))


_NUMBERS = ["total_floor_area", "co2_emissions_current", "brn", "rooms"]


def _numbers(spark, d) -> DataFrame:
    return base(spark, d).select("total_floor_area", "co2_emissions_current", "brn", clean.numeric(c("number_habitable_rooms")).alias("rooms"))


_NUMBER_ROWS = f"n AS (SELECT CAST(total_floor_area AS DOUBLE) AS total_floor_area, CAST(co2_emissions_current AS DOUBLE) AS co2_emissions_current, brn, {_number('number_habitable_rooms')} AS rooms FROM base)"
_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


@query(f"WITH {_NUMBER_ROWS} " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM n" for a, b in _PAIRS), "base")
def correlation_long(spark, d):
    return metrics.rounded(profile.correlations(_numbers(spark, d)), ["r"], 6)


@query(f"WITH {_NUMBER_ROWS}, r AS (" + " UNION ALL ".join(f"SELECT '{b}' AS feature, corr({a}, {b}) AS r FROM n" for a, b in _PAIRS) + ") SELECT DISTINCT feature FROM r WHERE abs(r) > 0.75 AND feature <> 'rooms'", "base")
def correlated_features(spark, d):
    return profile.correlated_features(_numbers(spark, d), exempt=("rooms",))


# ---------------------------------------------------------------- evaluation

_SCORED = """s AS (SELECT brn, sector, tenure, hp AS truth, brn % 7 < 2 AS guess, (brn % 101) / 100.0::DOUBLE AS sure, (brn * 37 % 1001) / 1000.0::DOUBLE AS share, (brn * 53 % 1101) / 1000.0::DOUBLE - 0.05::DOUBLE AS guessed, brn % 10 <> 0 AS training FROM base)"""


def _scored(spark, d) -> DataFrame:
    b = c("brn")
    return base(spark, d).select(
        "brn", "sector", "tenure", c("hp").alias("truth"), (b % 7 < 2).alias("guess"), ((b % 101) / F.lit(100.0)).alias("sure"), ((b * 37 % 1001) / F.lit(1000.0)).alias("share"),
        ((b * 53 % 1101) / F.lit(1000.0) - F.lit(0.05)).alias("guessed"), (b % 10 != 0).alias("training set"),
    )


_BIN = "CAST(least(floor(round_even({x} * 100, 0) / 5), 19) AS INT)"


@query(f"WITH {_SCORED} SELECT brn, b AS bin, CAST(b * 5 AS VARCHAR) || '-' || CAST((b + 1) * 5 AS VARCHAR) || '%' AS label FROM (SELECT brn, {_BIN.format(x='share')} AS b FROM s) q", "base")
def percentage_bins(spark, d):
    number = metrics.percentage_bin(c("share"))
    return _scored(spark, d).select("brn", number.alias("bin"), metrics.bin_label(number).alias("label"))


@query(f"WITH {_SCORED} SELECT truth, guess, count(*) AS n FROM s GROUP BY ALL", "base")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_scored(spark, d), "truth", "guess")


@query(f"WITH {_SCORED} SELECT round(avg(CAST(truth = guess AS DOUBLE)), 6) AS accuracy, round(count_if(truth AND guess) / nullif(count_if(guess), 0), 6) AS precision, round(count_if(truth AND guess) / nullif(count_if(truth), 0), 6) AS recall, round(2 * count_if(truth AND guess) / nullif(count_if(guess) + count_if(truth), 0), 6) AS f1 FROM s", "base")
def classification_metrics(spark, d):
    return metrics.rounded(metrics.classification_metrics(_scored(spark, d), "truth", "guess"), ["accuracy", "precision", "recall", "f1"], 6)


@query(f"WITH {_SCORED}, k AS (SELECT least(greatest(share, 0), 1) AS t, least(greatest(guessed, 0), 1) AS p FROM s) SELECT round(avg((p - t) * (p - t)), 6) AS mse, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(max(abs(p - t)), 6) AS max_error, round(avg(CAST({_BIN.format(x='t')} = {_BIN.format(x='p')} AS DOUBLE)), 6) AS bin_accuracy FROM k", "base")
def regression_metrics(spark, d):
    return metrics.rounded(metrics.regression_metrics(_scored(spark, d), "share", "guessed"), ["mse", "rmse", "max_error", "bin_accuracy"], 6)


@query(f"""WITH {_SCORED} SELECT brn, share, guessed AS "share: prediction", round(abs(share - guessed), 6) AS "share: error" FROM s""", "base")
def prediction_error(spark, d):
    out = metrics.with_error(_scored(spark, d), "share", "guessed", classification=False)
    return metrics.rounded(out, ["share: error"], 6).select("brn", "share", "`share: prediction`", "`share: error`")


@query("SELECT brn, CASE WHEN tenure IN ('owner-occupied', 'rental (private)', 'rental (social)') THEN tenure ELSE 'unknown' END AS tenure FROM base", "base")
def decode_one_hot(spark, d):
    values = ["owner-occupied", "rental (private)", "rental (social)"]
    hot = encode.one_hot(base(spark, d).select("brn", c("tenure").alias("TENURE")), ["TENURE"], {"TENURE": values})
    return hot.select("brn", metrics.decode_one_hot(hot, "TENURE", values).alias("tenure"))


@query(f"WITH {_SCORED} SELECT round(avg(share) * 100, 2) AS truth, round(avg(guessed) * 100, 2) AS prediction, round(avg(abs(share - guessed)) * 100, 2) AS error FROM s", "base")
def error_summary(spark, d):
    return metrics.error_summary(metrics.with_error(_scored(spark, d), "share", "guessed", False), "share")


@query(f"WITH {_SCORED} SELECT tenure, training, count(*) AS n, round(avg(share), 6) AS truth, round(avg(guessed), 6) AS prediction, round(avg(abs(share - guessed)), 6) AS error FROM s GROUP BY ALL", "base")
def error_by_category(spark, d):
    out = metrics.error_by_category(metrics.with_error(_scored(spark, d), "share", "guessed", False), "tenure", "share")
    return metrics.rounded(out, ["truth", "prediction", "error"], 6)


@query(f"WITH {_SCORED} SELECT tenure, count_if(truth AND guess) AS tp, count_if(NOT truth AND guess) AS fp, count_if(truth AND NOT guess) AS fn, count_if(NOT truth AND NOT guess) AS tn, count_if(truth AND guess AND sure > 0.9) AS tp_sure FROM s GROUP BY tenure", "base")
def outcome_slices(spark, d):
    return metrics.outcome_slices(_scored(spark, d), "tenure", "truth", "guess", "sure")


# ---------------------------------------------------------------- models


@query(f"WITH {_NUMBER_ROWS} SELECT brn, coalesce(rooms, (SELECT median(rooms) FROM n)) AS rooms FROM n", "base")
def impute_median(spark, d):
    df = _numbers(spark, d)
    return ml.impute(df, ml.fit_medians(df, ["rooms"])).select("brn", "rooms")


@query(f"WITH {_NUMBER_ROWS} SELECT brn, round((total_floor_area - (SELECT min(total_floor_area) FROM n)) / (SELECT max(total_floor_area) - min(total_floor_area) FROM n), 6) AS total_floor_area FROM n", "base")
def minmax_scale(spark, d):
    df = _numbers(spark, d).withColumn("total_floor_area", c("total_floor_area").cast("double"))
    return metrics.rounded(ml.min_max(df, ml.fit_ranges(df, ["total_floor_area"])).select("brn", "total_floor_area"), ["total_floor_area"], 6)


_MODEL_FEATURES = ["total_floor_area", "co2_emissions_current", "rooms", "rating", "roof", "floor"]


def _model_rows(spark, d, *more: str) -> DataFrame:
    number = lambda x: c(x).cast("double")
    return base(spark, d).select(
        *more, "brn", "sector", "hp", number("total_floor_area").alias("total_floor_area"), number("co2_emissions_current").alias("co2_emissions_current"), clean.numeric(c("number_habitable_rooms")).alias("rooms"),
        features.rating_number(c("current_energy_rating")).alias("rating"), encode.efficiency_value(c("roof_energy_eff")).alias("roof"), clean.floor_level(c("floor_level")).alias("floor"),
    )


def _area_rows(spark, d) -> DataFrame:
    rows = _model_rows(spark, d).groupBy("sector").agg(F.avg(c("hp").cast("double")).alias("share"), F.count_if("hp").alias("pumps"), F.count(F.lit(1)).alias("homes"), *(F.avg(f).alias(f) for f in _MODEL_FEATURES))
    return rows


@query()
def pca_90(spark, d):
    return ml.explained_variance(_model_rows(spark, d), _MODEL_FEATURES)


def _status(spark, d, model: str) -> DataFrame:
    return ml.train_and_predict(_model_rows(spark, d), "hp", _MODEL_FEATURES, "brn", model)


@query()
def logistic_status(spark, d):
    return _status(spark, d, "Logistic Regression")


@query()
def svm_status(spark, d):
    return _status(spark, d, "Linear Support Vector Classifier")


@query()
def forest_growth(spark, d):
    return ml.train_and_predict(_area_rows(spark, d), "share", _MODEL_FEATURES, "sector", "Random Forest Regressor")


@query()
def cv_scores(spark, d):
    return ml.cross_validate(_area_rows(spark, d), "share", _MODEL_FEATURES, "sector", "Linear Regression")


@query()
def param_search(spark, d):
    return ml.search_parameters(_area_rows(spark, d), "share", _MODEL_FEATURES, "sector", "Linear Regression")


@query()
def model_scores(spark, d):
    """Metrics of both classifiers of heat pumps on training and test rows."""
    return ml.evaluate_models(_model_rows(spark, d), ["hp"], _MODEL_FEATURES, "brn", ml.CLASSIFIERS)[0]


@query()
def trained_versions(spark, d):
    """Metrics, by version, model and target, of the predictions that the training driver has stored for all three questions."""
    numbers = _model_rows(spark, d).select("brn", *(c(f).alias(f"x_{f}") for f in _MODEL_FEATURES))
    homes = base(spark, d).withColumn("HP_INSTALLED", c("hp")).join(numbers, "brn")
    sets = {}
    for version in ("Current HP Status", "Future HP Status"):
        rows, targets = jobs.labelled(homes, version, key="uprn", tie="brn")
        sets[version] = training.LabelledSet(rows, tuple(targets), tuple(f"x_{f}" for f in _MODEL_FEATURES), "brn")
    df = base(spark, d).select("sector", "glazed_type", "current_energy_rating", *_AREA_COLUMNS, "uprn", "hp", "inspection_date", "brn")
    rows, targets = jobs.labelled(jobs.growth_by_area(df, "sector", 1997, 1999, ordinal=["current_energy_rating", "hp"], values=_GLAZED, key="uprn", installed="hp", date="inspection_date", tie="brn"), "HP Growth by Area", drop=("HP_COVERAGE_CURRENT",))
    sets["HP Growth by Area"] = training.LabelledSet(rows, tuple(targets), tuple(f for f in profile.numeric_columns(rows) if f not in targets), "sector")
    models = {v: ("Linear Regression",) if v == "HP Growth by Area" else ("Logistic Regression",) for v in sets}
    root = new_path(spark)
    training.train_parts(sets, root, models)
    return training.stored_metrics(spark, sets, root, models)


@query()
def truncated_svd(spark, d):
    return ml.singular_values(_model_rows(spark, d), _MODEL_FEATURES)


@query()
def top_coefficients(spark, d):
    return ml.important_coefficients(_model_rows(spark, d), "hp", _MODEL_FEATURES)


@query()
def poisson_area(spark, d):
    return ml.poisson_rates(_area_rows(spark, d), "pumps", "homes", ["total_floor_area", "rating", "roof"])


# ---------------------------------------------------------------- areas and their neighbours

_NEAR = f"""{_CELL},
a AS (SELECT cell, CAST(avg(CAST(hp AS INT)) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS w, CAST(split_part(cell, ':', 1) AS BIGINT) AS q, CAST(split_part(cell, ':', 2) AS BIGINT) AS r FROM cells GROUP BY cell),
n AS (SELECT x.cell, y.cell AS neighbour FROM a x JOIN a y ON greatest(abs(x.q - y.q), abs(x.r - y.r), abs(x.q + x.r - y.q - y.r)) = 1)"""


def _cell_shares(spark, d) -> DataFrame:
    pumps = c("hp").cast("int")
    rows = _cells(spark, d).withColumn("rating", features.rating_number(c("current_energy_rating")))
    return rows.groupBy("cell").agg(F.avg(pumps).alias("share"), F.count(F.lit(1)).alias("homes"), F.sum(pumps).alias("pumps"), F.coalesce(F.avg("rating"), F.lit(0.0)).alias("rating"))


@query(f"WITH {_NEAR} SELECT cell, neighbour FROM n", "coords", "base")
def neighbouring_cells(spark, d):
    return spatial.neighbouring_cells(_cell_shares(spark, d), "cell")


@query(f"""WITH {_NEAR} SELECT cell, round(u, 6) AS effect FROM (
  WITH RECURSIVE it AS (
    SELECT 0 AS k, cell, y AS u FROM a
    UNION ALL
    SELECT i.k + 1, a.cell, (a.w * a.y + 5.0 * coalesce(sum(j.u), 0)) / (a.w + 5.0 * count(j.u)) FROM it i JOIN a ON i.cell = a.cell LEFT JOIN n ON n.cell = a.cell LEFT JOIN it j ON j.cell = n.neighbour
    WHERE i.k < 300 GROUP BY i.k, a.cell, a.w, a.y)
  SELECT cell, u FROM it WHERE k = 300) z""", "coords", "base")
def smoothed_cells(spark, d):
    """Shares of heat pumps smoothed over neighbouring cells; SQL finds the same by three hundred rounds of averaging."""
    cells = _cell_shares(spark, d)
    out = spatial.smoothed_effects(cells, spatial.neighbouring_cells(cells, "cell"), "cell", "share", "homes", 5.0)
    return metrics.rounded(out, ["effect"], 6)


# ---------------------------------------------------------------- nearest neighbours


@query("""WITH v AS (SELECT vec_id, label = 3 AS adopted, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS adopter, b.vec_id AS neighbour, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.adopted AND NOT b.adopted),
r AS (SELECT *, row_number() OVER (PARTITION BY adopter ORDER BY distance, neighbour) AS rank FROM p)
SELECT adopter, neighbour, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 5""")
def nearest_non_adopters(spark, d):
    rows = table(spark, d, "embeddings").withColumn("adopted", c("label") == 3)
    return metrics.rounded(neighbours.nearest_non_adopters(rows, "vec_id", "embedding", "adopted"), ["distance"], 6)


_HOME_FEATURES = ["total_floor_area", "rooms", "rating", "roof"]
_RATED = "CASE current_energy_rating " + " ".join(f"WHEN '{r}' THEN {7 - k}.0" for k, r in enumerate("ABCDEFG")) + " END"
_ROOF = "CASE roof_energy_eff WHEN 'Poor | Very Good | N/A' THEN 3.5 WHEN 'Good |' THEN 4.0 WHEN 'Very Poor | Poor | Poor | Good' THEN 2.2 WHEN 'Average' THEN 3.0 ELSE 0.0 END"
_HOMES = f"""l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uprn ORDER BY inspection_date DESC NULLS FIRST, brn DESC) AS i FROM base WHERE uprn IS NOT NULL) q WHERE i = 1),
f AS (SELECT uprn, sector, hp, CAST(total_floor_area AS DOUBLE) AS a, {_number('number_habitable_rooms')} AS b, CAST({_RATED} AS DOUBLE) AS c, CAST({_ROOF} AS DOUBLE) AS d FROM l),
m AS (SELECT uprn, sector, hp, """ + ", ".join(f"coalesce({x}, median({x}) OVER ()) AS {x}" for x in "abcd") + """ FROM f),
v AS (SELECT uprn, sector, hp, [""" + ", ".join(f"CASE WHEN max({x}) OVER () > min({x}) OVER () THEN ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) ELSE 0 END" for x in "abcd") + """] AS e FROM m)"""


def _homes(spark, d) -> DataFrame:
    """The latest certificate of each property with its features, imputed and scaled, as one array."""
    rows = _model_rows(spark, d, "uprn", "inspection_date").where(c("uprn").isNotNull())
    latest = staged(entries.pick_entry(rows, "uprn", "latest entry", date="inspection_date", tie="brn").select("uprn", "sector", "hp", *_HOME_FEATURES))
    whole = ml.impute(latest, ml.fit_medians(latest, _HOME_FEATURES))
    return staged(ml.min_max(whole, ml.fit_ranges(whole, _HOME_FEATURES)).select("uprn", "sector", "hp", F.array(*_HOME_FEATURES).alias("vector")))


@query(f"""WITH {_HOMES},
p AS (SELECT a.uprn AS adopter, b.uprn AS neighbour, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.hp AND NOT b.hp),
r AS (SELECT neighbour, distance, row_number() OVER (PARTITION BY adopter ORDER BY distance, neighbour) AS rank FROM p),
t AS (SELECT neighbour, count(*) AS times, sum(distance) AS away FROM r WHERE rank <= 5 GROUP BY neighbour)
SELECT sector, count(*) AS homes, count(times) AS similar_homes, round(count(times) / count(*), 6) AS share, CAST(coalesce(sum(times), 0) AS BIGINT) AS times, round(sum(away) / sum(times), 6) AS mean_distance
FROM v LEFT JOIN t ON v.uprn = t.neighbour WHERE NOT hp GROUP BY sector""", "base")
def similar_areas(spark, d):
    """Areas by how alike their homes without a heat pump are to homes with one."""
    homes = _homes(spark, d)
    found = neighbours.nearest_non_adopters(homes, "uprn", "vector", "hp")
    return metrics.rounded(neighbours.similar_areas(found, homes, "uprn", "sector", "hp"), ["share", "mean_distance"], 6)


# ---------------------------------------------------------------- the operators on tables of other shapes


@query("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS i FROM orders) q WHERE i = 1")
def latest_order(spark, d):
    out = entries.pick_entry(table(spark, d, "orders"), "o_custkey", "latest entry", date="o_orderdate", tie="o_orderkey")
    return out.select("o_custkey", "o_orderkey", c("o_orderdate").cast("date").alias("day"))


@query("SELECT l_suppkey, feature, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey, feature), 6) AS share FROM (SELECT l_suppkey, 'l_returnflag' AS feature, l_returnflag AS category FROM lineitem UNION ALL SELECT l_suppkey, 'l_linestatus', l_linestatus FROM lineitem) q GROUP BY l_suppkey, feature, category")
def lineitem_shares(spark, d):
    return metrics.rounded(areas.category_shares(table(spark, d, "lineitem"), "l_suppkey", ["l_returnflag", "l_linestatus"]), ["share"], 6)


@query("SELECT l_suppkey, round(median(l_quantity), 6) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY l_suppkey")
def lineitem_median(spark, d):
    names = ["l_quantity", "l_extendedprice"]
    return metrics.rounded(areas.medians(table(spark, d, "lineitem"), "l_suppkey", names), names, 6)


@query("SELECT event_id, CASE WHEN n >= 5 THEN '5.0+' ELSE CAST(n AS VARCHAR) END AS n_user FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events) q")
def event_counts(spark, d):
    return entries.with_entry_counts(table(spark, d, "events"), {"n_user": "user_id"}).select("event_id", "n_user")


_SHARED = "CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END"


@query(f"SELECT {_SHARED} AS supplier, round(median(l_quantity), 6) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice, round(median(CASE WHEN l_discount > 0.02 THEN l_tax END), 6) AS l_tax FROM lineitem GROUP BY 1")
def median_of_a_large_group(spark, d):
    """Medians where a third of all rows are one group, which no aggregate holds."""
    names = ["l_quantity", "l_extendedprice", "l_tax"]
    rows = table(spark, d, "lineitem").withColumns({"supplier": F.expr(_SHARED), "l_tax": F.when(c("l_discount") > 0.02, c("l_tax"))}).select("supplier", *names)
    return metrics.rounded(areas.medians(rows, "supplier", names, heavy=1000), names, 6)


@query("SELECT event_id, CASE WHEN k IS NULL THEN NULL WHEN n >= 5 THEN '5.0+' ELSE CAST(n AS VARCHAR) END AS n_user FROM (SELECT event_id, k, count(*) OVER (PARTITION BY k) AS n FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 31 <> 0 THEN CAST(user_id AS VARCHAR) END AS k FROM events) p) q")
def entry_counts_of_a_heavy_key(spark, d):
    """Entry counts where a third of all rows have the key "unknown"."""
    key = F.when(c("event_id") % 3 == 0, "unknown").when(c("event_id") % 31 != 0, c("user_id").cast("string"))
    return entries.with_entry_counts(table(spark, d, "events").withColumn("k", key), {"n_user": "k"}, heavy=1000).select("event_id", "n_user")


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '42'), o_orderkey) AS place, count(*) OVER () AS total FROM orders),
t AS (SELECT max(total) AS total FROM p),
d AS (SELECT CAST('0x' || substr(md5('42:' || CAST(i AS VARCHAR)), 1, 14) AS BIGINT) % total + 1 AS place FROM t, unnest(range(5000)) AS r(i))
SELECT o_orderkey, count(*) AS times FROM d JOIN p ON d.place = p.place GROUP BY o_orderkey""")
def exact_sample(spark, d):
    """5,000 orders drawn with replacement, and how often each was."""
    drawn = sampling.exact_sample(table(spark, d, "orders").select("o_orderkey"), 5000, "o_orderkey")
    return drawn.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times"))


# ---------------------------------------------------------------- flagship


@query(rf"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uprn ORDER BY inspection_date DESC NULLS FIRST, brn DESC) AS i FROM base) q WHERE i = 1)
SELECT regexp_extract(pc, '([A-Z]+)', 1) AS area, count(*) AS properties, count_if(hp) AS heat_pumps, round(count_if(hp) / count(*), 6) AS coverage FROM l GROUP BY 1""", "base")
def coverage_by_area(spark, d):
    """Cleaned certificates, heat-pump flags, latest entry of each property, coverage by postcode area."""
    raw = epc(spark, d).withColumn(BRN, c(BRN).cast("long"))
    df = raw.withColumns({"POSTCODE_AREA": clean.postcode_level(clean.postcode(c("postcode")), "area"), **features.heating(c("mainheat_description"), c("secondheat_description"))})
    return jobs.coverage_of_latest(df, key="uprn", tie=BRN).withColumnRenamed("POSTCODE_AREA", "area")
