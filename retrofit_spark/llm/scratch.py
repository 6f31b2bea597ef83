"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Settings while a table is written: Spark removes the query's shuffle files when it has ended, and rows of many
#: KB go to Python workers in batches of bounded size.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def bounded(spark: SparkSession):
    """The settings for queries whose rows hold long texts or binaries."""
    conf = spark.conf
    before = {k: conf.get(k, None) for k in _WHILE_WRITING}
    try:
        for k, v in _WHILE_WRITING.items():
            conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


class Scratch:
    """Parquet tables in a new folder below spark.checkpoint.dir; where that is unset, in a temporary folder if Spark runs locally.

    A written table survives the loss of any executor and cuts the lineage. drop() frees a table
    that no later step reads; tables behind a returned DataFrame stay, as checkpoints do, until close().
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="spark-scratch-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with bounded(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Frees all tables."""
        self.drop("")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns can't clash with an operator's own."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
