"""Readers of the input files and of saved stages. CSV is read as text; cleaning gives it types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.joins import union_tables

ENGLAND_WALES = {"England": "domestic-E*", "Wales": "domestic-W*"}
SCOTTISH_NAMES = {"WALLS_ENERGY_EFF": "WALL_ENERGY_EFF", "POSTTOWN": "POST_TOWN"}
# Columns of the register of installations.
REGISTER_COLUMNS = (
    "date", "tech_type", "compressed_epc_address", "address_1", "address_2", "address_3", "postcode", "version",
    "n_certificates", "alt_type", "installation_type", "# records", "original_address",
)
IMD_COLUMNS = ("IMD Rank", "IMD Decile", "Postcode", "Income Score", "Employment Score")
STAGES = ("raw", "preprocessed", "preprocessed_dedupl")


def _csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", schema: StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader).csv(path)


def first_rows_of_files(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows of each file, in the order in which they were read."""
    if n is None:
        return df
    columns = df.columns
    read = df.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    return read.withColumn("__n", F.row_number().over(Window.partitionBy("__file").orderBy("__at"))).where(F.col("__n") <= n).select(columns)


def read_england_wales(spark: SparkSession, root: str, subset: str | None = None, columns: list[str] | None = None, n_rows: int | None = None, table: str = "certificates") -> DataFrame:
    """Certificates (or another table, such as recommendations) of England, Wales or both, with COUNTRY; a missing UPRN is filled by the building's reference number."""
    if subset not in (None, *ENGLAND_WALES):
        raise ValueError(f"subset {subset!r}: choose England, Wales or None for both")
    found = []
    for country, prefix in ENGLAND_WALES.items():
        if subset in (None, country):
            df = first_rows_of_files(_csv(spark, f"{root.rstrip('/')}/{prefix}/{table}.csv"), n_rows)
            if table == "certificates" and {"UPRN", "BUILDING_REFERENCE_NUMBER"} <= set(df.columns):
                df = df.withColumn("UPRN", F.coalesce("UPRN", "BUILDING_REFERENCE_NUMBER"))
            found.append((df.select(*columns) if columns else df).withColumn("COUNTRY", F.lit(country)))
    return union_tables(found)


def read_scotland(spark: SparkSession, root: str, names: list[str], columns: list[str] | None = None, n_rows: int | None = None) -> DataFrame:
    """Scottish certificates: ISO-8859-1, a line of long names and one of short ones before the rows. `names`: the columns in file order."""
    schema = StructType([StructField(c, StringType()) for c in names])
    df = first_rows_of_files(_csv(spark, f"{root.rstrip('/')}/*.csv", "ISO-8859-1", schema), None if n_rows is None else n_rows + 1)
    df = df.where(~F.col("POSTCODE").eqNullSafe("POSTCODE")).withColumnsRenamed({v: k for k, v in SCOTTISH_NAMES.items()})
    wanted = [c for c in columns or df.columns if c in df.columns]
    return df.select(*wanted).withColumn("COUNTRY", F.lit("Scotland"))


def read_certificates(spark: SparkSession, england_wales: str, scotland: str, scottish_names: list[str], subset: str = "GB", columns: list[str] | None = None, n_rows: int | None = None) -> DataFrame:
    """GB, Wales, England or Scotland."""
    if subset in ENGLAND_WALES:
        return read_england_wales(spark, england_wales, subset, columns, n_rows)
    if subset == "Scotland":
        return read_scotland(spark, scotland, scottish_names, columns, n_rows)
    if subset == "GB":
        return union_tables([read_england_wales(spark, england_wales, None, columns, n_rows), read_scotland(spark, scotland, scottish_names, columns, n_rows)])
    raise ValueError(f"subset {subset!r}: choose GB, Wales, England or Scotland")


def read_cleansed(spark: SparkSession, path: str, columns: list[str] | None = None, n_rows: int | None = None) -> DataFrame:
    """A third party's cleansed certificates, with HEAT_PUMP; the index column goes."""
    df = first_rows_of_files(_csv(spark, path), n_rows)
    df = df.drop("_c0", "Unnamed: 0").withColumn("HEAT_PUMP", F.col("FINAL_HEATING_SYSTEM") == "Heat pump")
    return df.select(*columns, "HEAT_PUMP") if columns else df


def stage_path(root: str, stage: str, snapshot: str | None = None) -> str:
    if stage not in STAGES:
        raise ValueError(f"stage {stage!r}: choose one of {', '.join(STAGES)}")
    return "/".join(p for p in (root.rstrip("/"), snapshot, stage) if p)


def read_stage(spark: SparkSession, root: str, stage: str, snapshot: str | None = None, columns: list[str] | None = None, n_rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(stage_path(root, stage, snapshot))
    df = df.select(*columns) if columns else df
    return df if n_rows is None else df.limit(n_rows)


def write_stage(df: DataFrame, root: str, stage: str, snapshot: str | None = None, partition_by: str | None = None, as_csv: bool = False) -> None:
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    path = stage_path(root, stage, snapshot)
    writer.option("header", True).csv(path) if as_csv else writer.parquet(path)


def read_deprivation(spark: SparkSession, root: str, countries: tuple[str, ...] = ("England", "Wales", "Scotland")) -> DataFrame:
    """Deprivation of countries; the country's column is IMD_COUNTRY, as COUNTRY would clash."""
    return union_tables([_csv(spark, f"{root.rstrip('/')}/{c.lower()}_imd.csv").select(*(f"`{x}`" for x in IMD_COLUMNS)).withColumn("IMD_COUNTRY", F.lit(c)) for c in countries])


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path).drop("id").select(F.col("postcode").alias("POSTCODE"), F.col("latitude").cast("double").alias("LATITUDE"), F.col("longitude").cast("double").alias("LONGITUDE"))


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """The register of installations; null parts of addresses are empty, the date is a date."""
    df = _csv(spark, path)
    df = df.select(*(F.col(f"`{c}`") for c in REGISTER_COLUMNS if c in df.columns))
    return df.fillna("", [c for c in ("address_1", "address_2", "address_3") if c in df.columns]).withColumn("date", F.try_to_date("date", "yyyy-MM-dd"))


def read_or_build(spark: SparkSession, path: str, build, preload: bool = True) -> DataFrame:
    """A saved table, or the one that `build` makes, saved."""
    if not preload:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_samples(spark: SparkSession, root: str, subset: str, build, preload: bool = True, least: int = 5_000_000) -> DataFrame:
    """The sample of complete areas of at least `least` rows ("5m"), or all rows ("complete"). `build` gives all rows."""
    from ..operators.sampling import complete_groups

    if subset not in ("5m", "complete"):
        raise ValueError(f"samples {subset!r}: choose '5m' or 'complete'")
    made = build if subset == "complete" else lambda: complete_groups(build(), "POSTCODE_UNIT", least)
    return read_or_build(spark, f"{root.rstrip('/')}/samples_{subset}", made, preload)


def write_predictions(df: DataFrame, root: str, model: str) -> None:
    """Predictions of one model, beside those of others; they take the place of its earlier ones."""
    df.withColumn("model", F.lit(model)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(f"{root.rstrip('/')}/predictions")
