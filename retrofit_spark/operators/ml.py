"""Models of property status and area growth with Spark ML."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce
from math import prod

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GeneralizedLinearRegression, GeneralizedLinearRegressionModel, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, profile, sampling
from .forest import DeepForest
from .staging import at_rest, release, staged
from .svm import HingeModel, LinearSVM

CLASSIFIERS = ("Logistic Regression", "Linear Support Vector Classifier")
REGRESSORS = ("Random Forest Regressor", "Linear Regression", "Decision Tree Regressor", "Poisson Regression")


def fit_medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact medians; a column without values gets 0.

    Approximate quantiles give a bracket of about two thousandths of the rows around the middle, and the middle values are
    picked from the bracket alone, so no aggregate holds a whole column.
    """
    own = {f: F.col(f"`{f}`").cast("double") for f in features}
    near = df.agg(*(x for f in features for x in (F.count(own[f]), F.percentile_approx(own[f], [0.499, 0.501], 10_000)))).head()
    brackets = {f: (near[2 * k], near[2 * k + 1]) for k, f in enumerate(features) if near[2 * k]}
    if not brackets:
        return dict.fromkeys(features, 0.0)
    below = df.agg(*(x for f, (_, (lo, hi)) in brackets.items() for x in (F.count_if(own[f] < lo), F.count_if(own[f].between(lo, hi))))).head()
    picks, places = [], []
    for k, (f, (n, (lo, hi))) in enumerate(brackets.items()):
        before, inside = below[2 * k], below[2 * k + 1]
        first, last = (n - 1) // 2, n // 2
        value = f"CASE WHEN `{f}` BETWEEN {lo!r}D AND {hi!r}D THEN CAST(`{f}` AS DOUBLE) END"
        if not before <= first <= last < before + inside:  # the quantiles' error was larger than the bracket
            value, before, inside = f"CAST(`{f}` AS DOUBLE)", 0, n
        picks += [F.expr(f"percentile_disc({(place - before + 0.5) / inside!r}D) WITHIN GROUP (ORDER BY {value})") for place in (first, last)]
        places.append(f)
    row = df.agg(*picks).head()
    return dict.fromkeys(features, 0.0) | {f: (row[2 * k] + row[2 * k + 1]) / 2 for k, f in enumerate(places)}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(m)) for f, m in medians.items()})


def fit_ranges(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*(g(f"`{f}`").cast("double") for f in features for g in (F.min, F.max))).head()
    return {f: (row[2 * k], row[2 * k + 1]) for k, f in enumerate(features)}


def min_max(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """0 for the least, 1 for the largest; constant columns are 0."""
    return df.withColumns({f: F.when(F.lit(lo == hi), 0.0).otherwise((F.col(f"`{f}`") - lo) / ((hi - lo) or 1.0)) for f, (lo, hi) in ranges.items() if lo is not None})


def estimator(name: str, features: str, label: str, n: int, params: dict | None = None):
    """A model by its name, with the parameters that the reported results use, or with others."""
    own = {"featuresCol": features, "labelCol": label}
    made = {
        "Logistic Regression": lambda: LogisticRegression(**own, standardization=False, regParam=1.0 / max(n, 1)),
        "Linear Support Vector Classifier": lambda: LinearSVM(**own),
        "Random Forest Regressor": lambda: DeepForest(**own),
        "Linear Regression": lambda: LinearRegression(**own),
        "Decision Tree Regressor": lambda: DecisionTreeRegressor(**own, maxDepth=15),
        "Poisson Regression": lambda: GeneralizedLinearRegression(**own, family="poisson", link="log"),
    }
    if name not in made:
        raise ValueError(f"model {name!r}: choose one of {', '.join(made)}")
    model = made[name]()
    return model.setParams(**params) if params else model


def reduced(shares: np.ndarray, variance: float) -> int:
    """How many leading components explain so much of the variance."""
    total, kept = 0.0, 0
    for share in shares:
        if total >= variance:
            break
        total, kept = total + share, kept + 1
    return max(1, kept)


@dataclass(frozen=True)
class Preparation:
    """Min-max scaling, and centring and rotation to the leading components where these are asked for, as one affine map of the features.

    shares: each component's share of the variance.
    """

    features: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    shares: np.ndarray | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `features`, a vector. Raises at a value that is null or not a number."""
        own = [F.col(f"`{f}`").cast("double") for f in self.features]
        own = [F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit(f"{f}: a value is null or not a number")).cast("double")).otherwise(x) for f, x in zip(self.features, own, strict=True)]
        rows = df.withColumns({f"__own_{k}": x for k, x in enumerate(own)})
        made = [reduce(lambda a, b: a + b, (F.col(f"__own_{k}") * F.lit(float(w)) for k, w in enumerate(column) if w), F.lit(float(b))) for column, b in zip(self.weights.T, self.offsets, strict=True)]
        return rows.withColumn("features", array_to_vector(F.array(*made))).drop(*(f"__own_{k}" for k in range(len(own))))


def fit_preparation(df: DataFrame, features: list[str], variance: float | None = 0.9) -> tuple[dict[str, float], Preparation]:
    """Medians; then min-max scaling and, if asked for, centring and PCA to a share of the variance.

    After the medians this takes one pass for ranges and means and one for the products of all pairs of features, from which those of the scaled ones follow.
    A constant feature is scaled to a half.
    """
    medians = fit_medians(df, features)
    full, d = impute(df, medians), len(features)
    row = full.agg(F.count(F.lit(1)), *(g(f"`{f}`") for g in (F.min, F.max, F.avg) for f in features)).head()
    if row[0] < (1 if variance is None else 2):
        raise ValueError("too few rows to prepare features on")
    lo, hi, mean = np.array(row[1:], float).reshape(3, d)
    if not np.isfinite(hi - lo).all():  # the largest is nan where any is
        raise ValueError("features must be finite numbers")
    varies = hi > lo
    scale = np.where(varies, 1 / np.where(varies, hi - lo, 1.0), 0.0)
    if variance is None:
        return medians, Preparation(features, np.diag(scale), np.where(varies, -lo * scale, 0.5))
    found = profile.co_moments(full, features, centre=mean)
    covariance = (found.products - found.sums * found.sums.T / row[0]) / (row[0] - 1) * np.outer(scale, scale)
    turned, strength, _ = np.linalg.svd(covariance)
    with np.errstate(invalid="ignore"):
        shares = strength / strength.sum()
    kept = turned[:, : reduced(shares, variance)]
    return medians, Preparation(features, scale[:, None] * kept, -(mean * scale) @ kept, shares)


def _linear(model) -> Column | None:
    """The linear predictor over `features`, as a column; None for models that aren't linear.

    Fitted linear models carry a training summary, and with it the session, into each task; their coefficients don't.
    """
    if not hasattr(model, "coefficients"):
        return None
    weights = F.array(*(F.lit(float(w)) for w in model.coefficients))
    return F.aggregate(F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w), F.lit(float(model.intercept)), lambda a, x: a + x)


def predict(df: DataFrame, model, classification: bool) -> DataFrame:
    """prediction, and "proba 0" and "proba 1" where the model gives probabilities."""
    score = _linear(model)
    if score is None:
        out = model.transform(df)
    elif isinstance(model, LogisticRegressionModel):
        out = df.withColumn("proba 1", 1 / (1 + F.exp(-score))).withColumn("proba 0", 1 - F.col("proba 1")).withColumn("prediction", (F.col("proba 1") > 0.5).cast("double"))
    elif isinstance(model, HingeModel):
        out = df.withColumn("prediction", (score > 0).cast("double"))
    else:
        out = df.withColumn("prediction", F.exp(score) if isinstance(model, GeneralizedLinearRegressionModel) else score)
    return out.withColumn("prediction", F.col("prediction").cast("boolean") if classification else F.col("prediction"))


def train_and_predict(df: DataFrame, target: str, features: list[str], key: str, model: str, test_share: float = 0.1, variance: float | None = 0.9, fit_on: str = "train", params: dict | None = None) -> DataFrame:
    """All rows with "training set", "<target>: prediction" and "<target>: error". Preparation is fitted on the training rows, or on all with fit_on="all".

    Fitting takes some dozen passes over the rows, so these are written once, and once more with their split.
    """
    classification, rows = model in CLASSIFIERS, at_rest(df)
    known = rows.where(F.col(f"`{target}`").isNotNull())
    marked = staged(sampling.split(known, key, test_share, target if classification else None).withColumn("__label", F.col(f"`{target}`").cast("double")))
    if rows is not df:
        release(rows)
    train = marked.where(F.col("`training set`"))
    medians, preparation = fit_preparation(train if fit_on == "train" else marked, features, variance)
    ready = preparation.transform(impute(marked, medians))
    learning = ready.where(F.col("`training set`")).select("features", "__label").cache()
    fitted = estimator(model, "features", "__label", learning.count(), params).fit(learning)
    learning.unpersist()
    out = metrics.with_error(predict(ready, fitted, classification), target, "prediction", classification)
    return out.drop("__label", "features", "prediction", "rawPrediction", "probability")


def evaluate_models(df: DataFrame, targets: list[str], features: list[str], key: str, models: tuple[str, ...], **options) -> tuple[DataFrame, dict[tuple[str, str], DataFrame]]:
    """Every model on every target: (model, target, training set, its metrics as a map), and the predictions, written once, by (model, target).

    Classes: accuracy, precision, recall, f1. Numbers: mse, rmse, max_error, bin_accuracy.
    """
    df, rows, found = at_rest(df), None, {}
    for model in models:
        for target in targets:
            out = found[model, target] = staged(train_and_predict(df, target, features, key, model, **options))
            measure = metrics.classification_metrics if model in CLASSIFIERS else metrics.regression_metrics
            for training in (True, False):
                own = measure(out.where(F.col("training set") == training), target, f"{target}: prediction")
                pairs = F.create_map(*(x for c in own.columns for x in (F.lit(c), F.col(c).cast("double"))))
                row = own.select(F.lit(model).alias("model"), F.lit(target).alias("target"), F.lit(training).alias("training set"), pairs.alias("metrics"))
                rows = row if rows is None else rows.unionByName(row)
    return rows, found


def _folds(df: DataFrame, target: str, features: list[str], key: str, folds: int, seed: int):
    """(training rows, test rows, number of training rows) of each fold, with features prepared on the training rows alone. Rows are worked out once for all folds."""
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds))
    marked = staged(df.select(*(F.col(f"`{f}`") for f in features), fold.alias("__fold"), F.col(f"`{target}`").cast("double").alias("label")))
    for k in range(folds):
        medians, preparation = fit_preparation(marked.where(F.col("__fold") != k), features)
        ready = preparation.transform(impute(marked, medians)).select("features", "label", "__fold").cache()
        train = ready.where(F.col("__fold") != k)
        yield train, ready.where(F.col("__fold") == k), train.count()
        ready.unpersist()


def _scores(df: DataFrame, model, classification: bool) -> dict[str, float]:
    out = predict(df, model, False)
    names = {"accuracy": "accuracy", "precision": "precisionByLabel", "recall": "recallByLabel", "f1": "fMeasureByLabel"}
    if classification:
        return {n: float(MulticlassClassificationEvaluator(metricName=m, metricLabel=1.0).evaluate(out)) for n, m in names.items()}
    row = metrics.regression_metrics(out, "label", "prediction").head()
    return {n: float(row[n]) if row[n] is not None else 0.0 for n in ("mse", "rmse", "max_error", "bin_accuracy")}


def cross_validate(df: DataFrame, target: str, features: list[str], key: str, model: str, folds: int = 5, seed: int = 42, params: dict | None = None) -> DataFrame:
    """fold, train_score, test_score (F1 of classes, RMSE of numbers) and all scores of both as maps.

    Medians, scaling and PCA are fitted on each fold's training rows.
    """
    classification = model in CLASSIFIERS
    main, rows = "f1" if classification else "rmse", []
    for k, (train, test, n) in enumerate(_folds(df, target, features, key, folds, seed)):
        fitted = estimator(model, "features", "label", n, params).fit(train)
        own = [_scores(part, fitted, classification) for part in (train, test)]
        rows.append((k, own[0][main], own[1][main], *own))
    return df.sparkSession.createDataFrame(rows, "fold int, train_score double, test_score double, train_scores map<string,double>, test_scores map<string,double>")


#: Points that searches draw from.
GRIDS = {
    "Linear Support Vector Classifier": {"alpha": [10.0**-k for k in range(6, 0, -1)], "l1_ratio": [0.0, 0.15, 1.0], "tol": [x * 10.0**-k for k in range(5, 1, -1) for x in (1, 5)]},
    "Logistic Regression": {"regParam": [10.0**-k for k in range(6, 0, -1)], "elasticNetParam": [0.0, 0.5, 1.0]},
    "Random Forest Regressor": {
        "n_trees": [5, 10, 20, *range(25, 301, 25)], "max_depth": [1, 3, 5, 7, *range(10, 101, 10), None], "max_features": [1, 2, 5, 10, 15, 20, 25, "auto", "sqrt"],
        "min_leaf": [2**k for k in range(6)], "min_split": [2, 5, 10, 15, 20], "bootstrap": [False, True],
    },
    "Decision Tree Regressor": {"maxDepth": [10, 20, 30], "minWeightFractionPerNode": [0.05, 0.1, 0.3, 0.49]},
    "Linear Regression": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
}


def search_parameters(df: DataFrame, target: str, features: list[str], key: str, model: str, grid: dict[str, list] | None = None, draws: int = 10, folds: int = 3, seed: int = 42) -> DataFrame:
    """params, score (mean over folds of F1 or RMSE) of randomly drawn points of a grid, best first. All points where `draws` reaches them."""
    classification = model in CLASSIFIERS
    grid = grid or GRIDS[model]
    size = prod(len(v) for v in grid.values())
    points = []
    for at in random.Random(seed).sample(range(size), min(draws, size)):
        point = {}
        for name, values in grid.items():
            at, own = divmod(at, len(values))
            point[name] = values[own]
        points.append(point)
    sums = [0.0] * len(points)
    for train, test, n in _folds(df, target, features, key, folds, seed):
        for k, point in enumerate(points):
            sums[k] += _scores(test, estimator(model, "features", "label", n, point).fit(train), classification)["f1" if classification else "rmse"] / folds
    order = F.col("score").desc() if classification else F.col("score").asc()
    return df.sparkSession.createDataFrame([(str(p), s) for p, s in zip(points, sums, strict=True)], "params string, score double").orderBy(order)


def important_coefficients(df: DataFrame, target: str, features: list[str], top: int = 10, model: str = "Logistic Regression") -> DataFrame:
    """feature, importance: coefficient times the feature's standard deviation; the most positive and most negative ones."""
    medians, preparation = fit_preparation(df, features, variance=None)
    ready = preparation.transform(impute(df, medians)).withColumn("label", F.col(f"`{target}`").cast("double"))
    fitted = estimator(model, "features", "label", ready.count()).fit(ready.select("features", "label"))
    values = vector_to_array("features")
    spread = ready.agg(*(F.stddev_pop(values[k]) for k in range(len(features)))).head()
    rows = sorted(((f, float(c) * float(s or 0)) for f, c, s in zip(features, fitted.coefficients, spread, strict=True)), key=lambda r: r[1])
    return df.sparkSession.createDataFrame(list(dict(rows[:top] + rows[-top:]).items()), "feature string, importance double")


def explained_variance(df: DataFrame, features: list[str]) -> DataFrame:
    """component, share of the variance, and the sum so far."""
    _, preparation = fit_preparation(df, features)
    rows, total = [], 0.0
    for k, share in enumerate(preparation.shares):
        total += float(share)
        rows.append((k, float(share), total))
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def singular_values(df: DataFrame, features: list[str], k: int = 10) -> DataFrame:
    """component, singular value and share of the sum of squares of the first k components of the scaled, uncentred features (truncated SVD)."""
    medians, preparation = fit_preparation(df, features, variance=None)
    ready = preparation.transform(impute(df, medians)).select("features")
    names = [str(n) for n in range(len(features))]
    values = vector_to_array("features")
    gram = profile.co_moments(ready.select(*(values[n].alias(name) for n, name in enumerate(names))), names, centred=False).products
    squares = np.maximum(np.linalg.eigvalsh(gram)[::-1], 0)
    total = float(squares.sum()) or 1.0
    return df.sparkSession.createDataFrame([(n, float(x) ** 0.5, float(x) / total) for n, x in enumerate(squares[:k])], "component int, singular_value double, share double")


def _log_factorial(n: Column) -> Column:
    """By Stirling's series ten places further on, where its error is below 1e-12."""
    x = n + 11
    series = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return series - reduce(lambda a, b: a + b, (F.log(n + k) for k in range(1, 11)))


def poisson_tail(count: Column, mean: Column) -> Column:
    """Probability that a Poisson variable of that mean exceeds the count; null where either is.

    Terms are summed away from the count, upwards if it is at the mean or beyond, so that small tails keep their digits; some dozen
    standard deviations of them are enough, whatever the count.
    """
    c, m = count.cast("double"), mean.cast("double")
    reach = F.sequence(F.lit(1), F.ceil(12 * F.sqrt(m) + 60).cast("int"))

    def summed(first: Column, factor) -> Column:
        start = F.struct(first.alias("term"), first.alias("sum"))
        step = lambda a, k: F.struct((a["term"] * factor(k)).alias("term"), (a["sum"] + a["term"] * factor(k)).alias("sum"))
        return F.aggregate(reach, start, step)["sum"]

    term = lambda n: F.exp(n * F.log(m) - m - _log_factorial(n))
    above = summed(term(c + 1), lambda k: m / (c + 1 + k))
    below = summed(term(c), lambda k: F.greatest(c + 1 - k, F.lit(0.0)) / m)
    known = F.when(c < 0, 1.0).when(m <= 0, 0.0).when(c >= m, above).otherwise(F.greatest(F.lit(0.0), 1 - below))
    return F.when(count.isNotNull() & mean.isNotNull(), known)


def poisson_rates(df: DataFrame, count: str, exposure: str, features: list[str], threshold: float | None = None) -> DataFrame:
    """Expected counts of areas by a Poisson regression with log link and the exposure as offset.

    `exceedance` is the probability that the area's count exceeds what was observed, which is small for areas with more
    than the model explains; with a threshold, that it exceeds this share of the exposure. Areas without exposure are left out.
    """
    ready = df.where(F.col(exposure) > 0).withColumns({"__offset": F.log(F.col(exposure).cast("double")), "__label": F.col(count).cast("double")})
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(ready)
    fitted = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features", labelCol="__label", offsetCol="__offset").fit(ready)
    out = ready.withColumn("expected", F.exp(_linear(fitted) + F.col("__offset")))
    bound = F.col(count) if threshold is None else F.floor(F.col(exposure) * F.lit(float(threshold)))
    return out.withColumn("exceedance", poisson_tail(bound, F.col("expected"))).drop("__offset", "__label", "features")
