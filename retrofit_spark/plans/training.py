"""Training and prediction by version of the question, model and target, each part of which is finished once."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, ml
from ..operators.staging import release, staged

#: Models of each version, and parameters of each model where they aren't its own.
MODELS = {
    "Current HP Status": ml.CLASSIFIERS,
    "Future HP Status": ml.CLASSIFIERS,
    "HP Growth by Area": ("Random Forest Regressor", "Linear Regression"),
}
TUNED: dict[str, dict] = {}


@dataclass(frozen=True)
class LabelledSet:
    """Rows of one version, the labels to be told, the features to tell them by, and a unique key."""

    rows: DataFrame
    targets: tuple[str, ...]
    features: tuple[str, ...]
    key: str


def part_path(root: str, version: str, model: str, target: str) -> str:
    return "/".join([root.rstrip("/"), *(re.sub(r"[^A-Za-z0-9]+", "_", x).strip("_").lower() for x in (version, model, target))])


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: Spark leaves a mark then, and not before."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark))


def train_parts(sets: dict[str, LabelledSet], root: str, models: dict[str, tuple[str, ...]] | None = None, params: dict[str, dict] | None = None, again: bool = False, **options) -> list[tuple[str, str, str]]:
    """Trains every model on every target of every version and writes its predictions below `root`: key, truth, "training set", prediction, error and probabilities.

    A part that an earlier run finished is left alone, unless `again`; what a broken run left of a part is replaced. Gives the parts that
    this run made. `params` holds a model's parameters by its name; options are those of ml.train_and_predict().
    """
    made = []
    for version, own in sets.items():
        rows = None  # of this version, written once if any part of it has to be made
        for model in (models or MODELS)[version]:
            for target in own.targets:
                spark, path = own.rows.sparkSession, part_path(root, version, model, target)
                if finished(spark, path) and not again:
                    continue
                if rows is None:
                    rows = staged(own.rows.select(*(F.col(f"`{c}`") for c in dict.fromkeys((own.key, *own.targets, *own.features)))))
                out = ml.train_and_predict(rows, target, list(own.features), own.key, model, params=(params or TUNED).get(model), **options)
                kept = [own.key, target, "training set", f"{target}: prediction", f"{target}: error", *(c for c in out.columns if c.startswith("proba "))]
                out.select(*(F.col(f"`{c}`") for c in kept)).write.mode("overwrite").parquet(path)
                made.append((version, model, target))
        if rows is not None:
            release(rows)
    return made


def stored_metrics(spark: SparkSession, sets: dict[str, LabelledSet], root: str, models: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """version, model, target, "training set" and the metrics as a map, of the predictions that are stored; a part that isn't finished raises."""
    rows = None
    for version, own in sets.items():
        for model in (models or MODELS)[version]:
            for target in own.targets:
                path = part_path(root, version, model, target)
                if not finished(spark, path):
                    raise FileNotFoundError(f"{version}, {model}, {target}: no finished predictions in {path}")
                measure = metrics.classification_metrics if model in ml.CLASSIFIERS else metrics.regression_metrics
                stored = spark.read.parquet(path)
                for training in (True, False):
                    found = measure(stored.where(F.col("training set") == training), target, f"{target}: prediction")
                    pairs = F.create_map(*(x for c in found.columns for x in (F.lit(c), F.col(c).cast("double"))))
                    row = found.select(*(F.lit(x).alias(n) for n, x in (("version", version), ("model", model), ("target", target), ("training set", training))), pairs.alias("metrics"))
                    rows = row if rows is None else rows.unionByName(row)
    return rows
