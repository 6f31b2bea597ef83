"""Linear support vector machine with an elastic-net penalty, by proximal Newton steps.

Minimised is the mean hinge loss + alpha * ((1 - l1_ratio) / 2 * |w|^2 + l1_ratio * |w|_1); the intercept isn't penalised. The hinge is rounded off
within a width that shrinks from stage to stage, each stage starting where the last one ended. A step takes the loss's gradient and curvature, sums over
blocks of rows that are made in the tasks that hold them and put together as a tree. The driver, which holds a square of the number of features and no
rows, solves the penalised quadratic with soft thresholds; then one pass measures a series of step lengths, and the slopes at the first of them for the next step. A stage ends when the objective falls by
less than `tol` of itself.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003)
#: Step lengths that are measured at once.
LENGTHS = 0.5 ** np.arange(12)
#: Added to the curvature, beside its mean.
DAMPING = 1e-6
#: Rounds of the quadratic problem on the driver.
INNER = 400


@dataclass(frozen=True)
class HingeModel:
    """coefficients, intercept, the objective reached and the steps taken."""

    coefficients: np.ndarray
    intercept: float
    objective: float
    steps: int


def _blocks(batches):
    """Rows as (n, the features and a one for the intercept, signs)."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            sign = np.where(batch.column(1).to_numpy(zero_copy_only=False) > 0, 1.0, -1.0)
            signed = np.column_stack((x, np.ones(len(x)))) * sign[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([signed.shape[1]], pa.int32()), pa.array([signed.astype("<f8").tobytes()], pa.binary())], ["d", "signed"])


def _slopes(signed: np.ndarray, w: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the rounded hinge."""
    gap = 1 - signed @ w
    bent = signed[(gap > 0) & (gap <= width)]
    return -(np.clip(gap / width, 0, 1) @ signed), bent.T @ bent / width


def _losses(signed: np.ndarray, points: np.ndarray, width: float) -> np.ndarray:
    """Sums of the rounded and of the true hinge at each point."""
    gaps = signed @ points.T
    np.subtract(1, gaps, out=gaps)
    hinge = np.maximum(gaps, 0, out=gaps).sum(0)
    bent = np.minimum(gaps, width, out=gaps)  # what is beyond the width counts in full, what is within it by its square
    return np.stack((hinge - bent.sum(0) + np.einsum("ij,ij->j", bent, bent) / (2 * width), hinge))


def quadratic_step(gradient: np.ndarray, curved: np.ndarray, w: np.ndarray, shrink: np.ndarray) -> np.ndarray:
    """The point of the least gradient . (v - w) + (v - w) . curved . (v - w) / 2 + shrink . |v|, by accelerated soft thresholds."""
    step = 1 / max(float(np.linalg.eigvalsh(curved)[-1]), 1e-300)
    v = ahead = w
    momentum = 1.0
    for _ in range(INNER):
        moved = ahead - step * (gradient + curved @ (ahead - w))
        after = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)
        if (ahead - after) @ (after - v) > 0:  # the momentum leads uphill
            momentum = 1.0
        further = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, moved, v, momentum = after + (momentum - 1) / further * (after - v), v, after, further
        if np.abs(v - moved).max() <= 1e-12 * (1 + np.abs(v).max()):
            break
    return v


@dataclass(frozen=True)
class LinearSVM:
    """The estimator: fit() takes a vector column and a label column, 1 and 0."""

    featuresCol: str = "features"
    labelCol: str = "label"
    alpha: float = 1e-4
    l1_ratio: float = 0.15
    tol: float = 5e-4
    max_iter: int = 5000

    def setParams(self, **params) -> LinearSVM:
        return replace(self, **params)

    def penalty(self, w: np.ndarray) -> float:
        return self.alpha * ((1 - self.l1_ratio) / 2 * float(w @ w) + self.l1_ratio * float(np.abs(w).sum()))

    def fit(self, df: DataFrame) -> HingeModel:
        """Needs rows of both labels to be of use; without any row all coefficients would be undefined, which raises."""
        rows = df.select(vector_to_array(self.featuresCol).alias("x"), F.col(self.labelCol).cast("double").alias("y"))
        blocks = rows.mapInArrow(_blocks, "d int, signed binary").rdd.map(lambda r: np.frombuffer(r.signed, "<f8").reshape(-1, r.d)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._descend(blocks)
        finally:
            blocks.unpersist()

    def _descend(self, blocks) -> HingeModel:
        sizes = blocks.map(lambda b: (len(b), b.shape[1])).treeReduce(lambda a, b: (a[0] + b[0], b[1])) if not blocks.isEmpty() else None
        if sizes is None:
            raise ValueError("no rows to learn from")
        n, d = sizes
        shrink = np.append(np.full(d - 1, self.alpha * self.l1_ratio), 0.0)
        ridge = np.append(np.full(d - 1, self.alpha * (1 - self.l1_ratio)), 0.0)

        def measured(points: np.ndarray, width: float, slopes: bool = True):
            """Objectives of the rounded and of the true hinge at each point, and the slopes at the first one, in one pass."""
            task = lambda b: (_losses(b, points, width), *(_slopes(b, points[0], width) if slopes else ()))
            sums, *bent = blocks.map(task).treeReduce(lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))
            return sums / n + np.array([self.penalty(p[:-1]) for p in points]), bent

        w, taken = np.zeros(d), 0
        for width in WIDTHS:
            found, slopes = measured(w[None], width)
            now, damping = float(found[0, 0]), DAMPING
            while taken < self.max_iter:
                taken += 1
                gradient, curved = slopes
                damped = curved / n + np.diag(ridge + damping * (1 + np.trace(curved) / n / d))
                way = quadratic_step(gradient / n + ridge * w, damped, w, shrink) - w
                points = w + LENGTHS[:, None] * way
                (found, _), ahead = measured(points, width)
                best = int(found.argmin())
                fall, before = now - float(found[best]), now
                if fall > 0:
                    w, now = points[best], float(found[best])
                if fall <= self.tol * abs(before):
                    if damping >= 1 or fall > 0:
                        break
                    damping *= 1000  # the quadratic is too flat to say how far to go
                elif taken < self.max_iter:  # the whole step is the best as a rule, and its slopes are known
                    slopes = ahead if best == 0 else measured(w[None], width)[1]
        return HingeModel(w[:-1], float(w[-1]), float(measured(w[None], WIDTHS[-1], False)[0][1, 0]), taken)
