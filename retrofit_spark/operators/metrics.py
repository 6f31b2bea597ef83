"""Evaluation of predictions as aggregates, and error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentage_bin(c: Column, width: int = 5) -> Column:
    """Number of the bin of a share of 0 to 1 after rounding to hundredths, halves to even; 1 is in the last bin."""
    return F.when(c.isNotNull(), F.least(F.floor(F.rint(c * 100) / width), F.lit(100 // width - 1))).cast("int")


def bin_label(number: Column, width: int = 5) -> Column:
    return F.concat((number * width).cast("string"), F.lit("-"), ((number + 1) * width).cast("string"), F.lit("%"))


def confusion_matrix(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.groupBy(truth, prediction).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """accuracy, precision, recall, f1 of boolean columns, in one aggregate; null where there is nothing to divide by."""
    t, p = F.col(truth), F.col(prediction)
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(t == p).alias("right"), F.count_if(t & p).alias("tp"), F.count_if(p).alias("positive"), F.count_if(t).alias("real"))
    return counts.select(
        F.try_divide("right", "n").alias("accuracy"), F.try_divide("tp", "positive").alias("precision"), F.try_divide("tp", "real").alias("recall"),
        F.try_divide(F.lit(2) * F.col("tp"), F.col("positive") + F.col("real")).alias("f1"),
    )


def regression_metrics(df: DataFrame, truth: str, prediction: str, width: int = 5) -> DataFrame:
    """mse, rmse, max_error, bin_accuracy of shares clipped to 0 to 1."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    error = clip(prediction) - clip(truth)
    same = percentage_bin(clip(truth), width) == percentage_bin(clip(prediction), width)
    return df.agg(F.avg(error * error).alias("mse"), F.max(F.abs(error)).alias("max_error"), F.avg(same.cast("double")).alias("bin_accuracy")).withColumn("rmse", F.sqrt("mse"))


def with_error(df: DataFrame, target: str, prediction: str, classification: bool) -> DataFrame:
    """"target: prediction" and "target: error": whether they differ, or by how much."""
    t, p = F.col(f"`{target}`"), F.col(f"`{prediction}`")
    return df.withColumns({f"{target}: prediction": p, f"{target}: error": (t != p) if classification else F.abs(t - p)})


def decode_one_hot(df: DataFrame, feature: str, values: list[str], default: str = "unknown") -> Column:
    """The category whose column is 1."""
    return F.coalesce(*(F.when(F.col(f"`{feature}: {v}`") == 1, v) for v in values), F.lit(default))


def error_summary(df: DataFrame, target: str) -> DataFrame:
    """Means of truth, prediction and error in percent, to two decimals."""
    mean = lambda c: F.round(F.avg(F.col(f"`{c}`").cast("double")) * 100, 2)
    return df.agg(mean(target).alias("truth"), mean(f"{target}: prediction").alias("prediction"), mean(f"{target}: error").alias("error"))


def error_by_category(df: DataFrame, category: str, target: str, training: str = "training set") -> DataFrame:
    mean = lambda c: F.avg(F.col(f"`{c}`").cast("double"))
    return df.groupBy(category, F.col(f"`{training}`").alias("training")).agg(F.count(F.lit(1)).alias("n"), mean(target).alias("truth"), mean(f"{target}: prediction").alias("prediction"), mean(f"{target}: error").alias("error"))


def outcome_slices(df: DataFrame, category: str, truth: str, prediction: str, confidence: str, least: float = 0.9) -> DataFrame:
    """True and false positives and negatives of each category, and the true positives that are sure."""
    t, p = F.col(truth), F.col(prediction)
    return df.groupBy(category).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & p & (F.col(confidence) > least)).alias("tp_sure"))


def share_of(df: DataFrame, condition: Column, name: str = "share") -> DataFrame:
    return df.agg(F.avg(condition.cast("double")).alias(name))


def rounded(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})
