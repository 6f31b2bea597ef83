"""Intermediate results that outlive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def new_path(spark: SparkSession) -> str:
    """A place below the folder that the session names in spark.checkpoint.dir; on one machine, where that is unset, below a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-stages-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The frame, worked out once and written to a new place. Columns of nulls without a type aren't written, but come back."""
    path, void = new_path(df.sparkSession), {f.name for f in df.schema if f.dataType == NullType()}
    kept = df.drop(*void) if void else df
    kept.write.parquet(path)
    out = df.sparkSession.read.schema(kept.schema).parquet(path)
    if void:
        out = out.select(*(F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns))
    out._staged_at = path
    return out


def at_rest(df: DataFrame) -> DataFrame:
    """The frame itself if it is a staged one, else staged."""
    return df if getattr(df, "_staged_at", None) else staged(df)


def release(*frames: DataFrame) -> None:
    """Frees staged frames that nothing reads any more; others are left alone."""
    for df in frames:
        at = getattr(df, "_staged_at", None)
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
