"""Random forests of any depth, grown level by level on the cluster.

A row stands once for each tree, with the node that it has come to and how often it was drawn. A level counts rows and sums the label by (node, feature,
bin); sums over bins from the left give every possible split, and each node takes the best. Rows then move to the child that
their bin says, or stay, if their node doesn't split. Nodes are numbered by level, so depth has no bound; splits stay tables, so neither has the number of
nodes. The driver holds thresholds of features only. Once no node has more than LOCAL rows, each node's rows meet in one task, which grows all that is
below it: one job in place of some for each level.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from math import exp, factorial, isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import release, staged

BINS = 256
#: Rows of a node below which one task grows the rest, at most 2 ** 15: a level has no more nodes than that.
LOCAL = 1 << 14
_BITS = 15
_GROWN = pa.schema([("level", pa.int32()), ("node", pa.int64()), ("f", pa.int32()), ("bin", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("value", pa.float64())])


def thresholds(rows: DataFrame, dims: int, bins: int = BINS) -> list[np.ndarray]:
    """Where each feature of `x` may be split: between all of its values if they are no more than `bins`, else at quantiles."""
    out = []
    for k in range(dims):
        value = rows.select(F.col("x")[k].alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        values = sorted(r.v for r in value.distinct().limit(bins + 1).collect())
        if len(values) <= bins:
            out.append(np.array([(a + b) / 2 for a, b in zip(values[:-1], values[1:], strict=True)]))
        else:
            out.append(np.unique(value.agg(F.percentile_approx("v", [k / bins for k in range(1, bins)], 100 * bins)).head()[0]))
    return out


def _binned(cuts: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index("x")
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)  # null is nan, and comes last
                bins = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(cuts), pa.int32()), pa.array(bins.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], lists, *batch.columns[at + 1 :]], [*batch.schema.names[:at], "bins", *batch.schema.names[at + 1 :]])

    return run


def drawn(row: Column, tree: Column, seed: int) -> Column:
    """How often a row is in a tree's sample with replacement: a Poisson variable of mean 1, by hash."""
    u = F.pmod(F.xxhash64(F.lit(seed), tree, row), F.lit(1 << 53)) / F.lit(float(1 << 53))
    upto = np.cumsum([exp(-1) / factorial(k) for k in range(12)])
    return reduce(lambda a, b: a + b, ((u >= F.lit(float(p))).cast("int") for p in upto))


@dataclass(frozen=True)
class ForestModel:
    """levels: the splits of each level (node, f, bin, left, right); leaves: (level, node, value); trees that are averaged."""

    featuresCol: str
    cuts: list[np.ndarray]
    trees: int
    levels: list[DataFrame]
    leaves: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `prediction`, the mean of the trees' leaves."""
        rows = staged(df.withColumn("__row", F.monotonically_increasing_id()))
        x = rows.select(F.col("__row").alias("row"), vector_to_array(self.featuresCol).cast("array<double>").alias("x"))
        state = _on_roots(x.mapInArrow(_binned(self.cuts), "row long, bins array<int>"), self.trees)
        ended = []
        for level, splits in enumerate(self.levels):
            own = self.leaves.where(F.col("level") == level).drop("level")
            ended.append(state.join(own, "node").select("row", "value"))
            state = staged(_moved(state, splits))
        ended.append(state.join(self.leaves.where(F.col("level") == len(self.levels)).drop("level"), "node").select("row", "value"))
        mean = reduce(DataFrame.unionByName, ended).groupBy("row").agg(F.avg("value").alias("prediction"))
        return rows.join(mean, F.col("__row") == F.col("row"), "left").drop("__row", "row")


def _on_roots(binned: DataFrame, trees: int) -> DataFrame:
    """Each row at the root of each tree: node k is tree k's."""
    return binned.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.col("tree").cast("long"))


def _moved(state: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of nodes that split, at their children."""
    inner = state.join(splits, "node")
    left = F.element_at("bins", F.col("f") + 1) <= F.col("bin")
    return inner.withColumn("node", F.when(left, F.col("left")).otherwise(F.col("right"))).drop("f", "bin", "left", "right")


@dataclass(frozen=True)
class DeepForest:
    """The estimator. A node of fewer than min_split rows, or at max_depth (None: no bound), doesn't split; a child has at least min_leaf rows. Rows count once, however often they were drawn.

    Each node looks at max_features features, drawn by hash ("sqrt", "auto": all, or a number; features that are constant there count).
    """

    featuresCol: str = "features"
    labelCol: str = "label"
    n_trees: int = 175
    max_depth: int | None = 90
    min_leaf: int = 8
    min_split: int = 15
    max_features: int | str = 5
    bootstrap: bool = True
    bins: int = BINS
    seed: int = 42

    def setParams(self, **params) -> DeepForest:
        return replace(self, **params)

    def _taken(self, dims: int) -> int:
        return min(dims, {"sqrt": max(1, isqrt(dims)), "auto": dims}[self.max_features] if isinstance(self.max_features, str) else int(self.max_features))

    def fit(self, df: DataFrame) -> ForestModel:
        rows = staged(df.select(F.monotonically_increasing_id().alias("row"), F.col(self.labelCol).cast("double").alias("y"), vector_to_array(self.featuresCol).cast("array<double>").alias("x")))
        first = rows.agg(F.first(F.size("x")).alias("d"), F.count(F.lit(1)).alias("n")).head()
        if not first.d:
            raise ValueError("no rows or no features to learn from")
        cuts, taken = thresholds(rows, first.d, self.bins), self._taken(first.d)
        state = _on_roots(rows.mapInArrow(_binned(cuts), "row long, y double, bins array<int>"), self.n_trees)
        weight = drawn(F.col("row"), F.col("tree"), self.seed) if self.bootstrap else F.lit(1)
        state, most = state.withColumn("w", weight).where("w > 0"), first.n
        if most > LOCAL:
            state = staged(state)
        levels, leaves = [], []
        while True:
            depth = len(levels)
            if most > LOCAL and depth:
                most = state.groupBy("node").count().agg(F.max("count")).head()[0] or 0
            if most <= LOCAL:
                grown = staged(state.groupBy("node").applyInArrow(self._below(depth, taken), "level int, node long, f int, bin int, left long, right long, value double"))
                deepest = grown.where("f IS NOT NULL").agg(F.max("level")).head()[0]
                levels += [grown.where((F.col("level") == k) & F.col("f").isNotNull()).drop("level", "value") for k in range(depth, depth if deepest is None else deepest + 1)]
                leaves.append(grown.where("f IS NULL").select("level", "node", "value"))
                break
            nodes = state.groupBy("node").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value"))
            splits = self._splits(state, first.d, taken, depth) if self.max_depth is None or depth < self.max_depth else None
            splits = None if splits is None else staged(splits)
            if splits is None or splits.isEmpty():
                leaves.append(nodes.select(F.lit(depth).alias("level"), "node", "value"))
                break
            leaves.append(nodes.join(splits, "node", "left_anti").select(F.lit(depth).alias("level"), "node", "value"))
            leaves[-1] = staged(leaves[-1])
            levels.append(splits)
            before, state = state, staged(_moved(state, splits))
            release(before)
        return ForestModel(self.featuresCol, cuts, self.n_trees, levels, staged(reduce(DataFrame.unionByName, leaves)))

    def _below(self, depth: int, taken: int):
        """All nodes from one of level `depth` down, from its rows: splits, and leaves with their values. Nodes below are numbered by the first one's number and their place in the level."""
        least = max(self.min_split, 2 * self.min_leaf)

        def best_split(bins: np.ndarray, w: np.ndarray, s: np.ndarray, features: np.ndarray) -> tuple[int, int] | None:
            whole, best, found = s.sum() ** 2 / w.sum(), -np.inf, None
            for f in features.tolist():
                n_left, w_left, s_left = np.bincount(bins[:, f]).cumsum(), np.bincount(bins[:, f], w).cumsum(), np.bincount(bins[:, f], s).cumsum()
                fits = np.flatnonzero((n_left >= self.min_leaf) & (len(w) - n_left >= max(self.min_leaf, 1)))
                if len(fits):
                    gain = s_left[fits] ** 2 / w_left[fits] + (s_left[-1] - s_left[fits]) ** 2 / (w_left[-1] - w_left[fits]) - whole
                    k = int(gain.argmax())
                    if gain[k] > max(best, 1e-12 * (1 + whole)):
                        best, found = gain[k], (f, int(fits[k]))
            return found

        def run(table: pa.Table) -> pa.Table:
            y, w = (table.column(c).to_numpy().astype(float) for c in "yw")
            bins, first = table.column("bins").combine_chunks().flatten().to_numpy().reshape(len(y), -1), table.column("node")[0].as_py()
            s, out, now, level = w * y, [], [(first, np.arange(len(y)))], depth
            while now:
                below = []
                for node, rows in now:
                    split = None
                    if len(rows) >= least and (self.max_depth is None or level < self.max_depth):
                        every = np.arange(bins.shape[1])
                        picked = every if taken == len(every) else np.sort(np.random.default_rng([self.seed, level, node]).permutation(every)[:taken])
                        split = best_split(bins[rows], w[rows], s[rows], picked)
                    if split is None:
                        out.append((level, node, None, None, None, None, s[rows].sum() / w[rows].sum()))
                        continue
                    left = bins[rows, split[0]] <= split[1]
                    children = [(first << _BITS) + len(below) + k for k in (0, 1)]
                    below += [(children[0], rows[left]), (children[1], rows[~left])]
                    out.append((level, node, *split, *children, None))
                now, level = below, level + 1
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _GROWN.types, strict=True)], schema=_GROWN)

        return run

    def _splits(self, state: DataFrame, dims: int, taken: int, depth: int) -> DataFrame:
        """node, f, bin (the last one on the left), left, right: the split of each node that takes most from the squared error; ties go to the first feature and bin."""
        every = F.sequence(F.lit(0), F.lit(dims - 1))
        picked = F.transform(F.slice(F.array_sort(F.transform(every, lambda f: F.struct(F.xxhash64(F.lit(self.seed), F.lit(depth), "node", f).alias("h"), f.alias("f")))), 1, taken), lambda s: s["f"])
        nodes = state.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= max(self.min_split, 2 * self.min_leaf))
        nodes = nodes.select("node", (every if taken == dims else picked).alias("features"))
        wide = state.join(nodes, "node").withColumn("f", F.explode("features"))
        sums = wide.groupBy("node", "f", F.element_at("bins", F.col("f") + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").cast("double").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
        whole = Window.partitionBy("node", "f")
        upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        part = sums.select("node", "f", "bin", *(F.sum(c).over(upto).alias(f"{c}_left") for c in "nws"), *(F.sum(c).over(whole).alias(f"{c}_all") for c in "nws"))
        n_right, w_right, s_right = (F.col(f"{c}_all") - F.col(f"{c}_left") for c in "nws")
        gain = F.pow("s_left", F.lit(2)) / F.col("w_left") + F.pow(s_right, F.lit(2)) / w_right - F.pow("s_all", F.lit(2)) / F.col("w_all")
        fits = part.where((F.col("n_left") >= self.min_leaf) & (n_right >= self.min_leaf) & (w_right > 0)).withColumn("gain", gain)
        fits = fits.where(F.col("gain") > 1e-12 * (1 + F.pow("s_all", F.lit(2)) / F.col("w_all")))
        best = fits.groupBy("node").agg(F.min_by(F.struct("f", "bin"), F.struct(-F.col("gain"), "f", "bin")).alias("best"))
        numbered = best.select("node", "best.f", "best.bin", F.monotonically_increasing_id().alias("k"))
        return numbered.select("node", "f", "bin", (2 * F.col("k")).alias("left"), (2 * F.col("k") + 1).alias("right"))
