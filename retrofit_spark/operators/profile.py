"""Profiles of columns, and correlations."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def value_profile(df: DataFrame, column: str) -> DataFrame:
    """Each value, null among them, with its rows."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def null_columns(df: DataFrame) -> DataFrame:
    """column_name, all_null of every column, in one pass."""
    counts = df.agg(*(F.count(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), (F.col(f"c{k}") == 0).alias("all_null")) for k, c in enumerate(df.columns)))
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def drop_null_columns(df: DataFrame) -> DataFrame:
    return df.drop(*(r.column_name for r in null_columns(df).where("all_null").collect()))  # a row per column at most


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def columns_like(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.upper().startswith(tuple(p.upper() for p in prefixes))]


@dataclass(frozen=True)
class CoMoments:
    """For each two features, over rows where both are there: n rows, sums of the first one (transposed: of the second), of its squares, and of products; all of values less `centre`."""

    features: list[str]
    centre: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    products: np.ndarray

    def correlation(self) -> np.ndarray:
        """Pearson's r; nan where one of the two doesn't vary, or fewer than two rows have both."""
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = self.squares - self.sums**2 / self.n
            spread[spread <= 1e-12 * self.squares] = np.nan
            r = (self.products - self.sums * self.sums.T / self.n) / np.sqrt(spread * spread.T)
        r[self.n < 2] = np.nan
        return np.clip(r, -1, 1)


def co_moments(df: DataFrame, features: list[str], centred: bool = True, centre: np.ndarray | None = None) -> CoMoments:
    """Sums for all pairs of features in one job, after one for the means, unless a centre is given: a task multiplies blocks of its rows, and squares of the number of features are added up as a tree."""
    d = len(features)
    own = [F.col(f"`{f}`").cast("double") for f in features]
    if centre is None and not centred:
        centre = np.zeros(d)
    elif centre is None:
        centre = np.array([x if x is not None and math.isfinite(x) else 0.0 for x in df.agg(*(F.avg(x) for x in own)).head()])

    def run(batches):
        total = np.zeros((4, d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - centre  # null is nan
            there = ~np.isnan(x)
            x, mask = np.where(there, x, 0.0), there.astype(float)
            total += np.stack((mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = df.select(F.array(*own).alias("x")).mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r.sums).reshape(4, d, d))
    return CoMoments(list(features), centre, *(np.zeros((4, d, d)) if parts.isEmpty() else parts.treeReduce(np.add)))


def correlations(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """feature_a, feature_b, r for every pair in order: Pearson's over rows where both are there; null where there is none."""
    features = features or numeric_columns(df)
    r = co_moments(df, features).correlation() if len(features) > 1 else np.zeros((0, 0))
    rows = [(features[i], features[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i, j in combinations(range(len(features)), 2)]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def correlated_features(df: DataFrame, features: list[str] | None = None, limit: float = 0.75, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Features that correlate by more than `limit` with one before them, but for those exempt."""
    found = correlations(df, features).where((F.abs("r") > limit) & ~F.col("feature_b").isin(*exempt) if exempt else F.abs("r") > limit)
    return found.select(F.col("feature_b").alias("feature")).distinct()


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame with its row count observed as it is written: no job of its own."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch
