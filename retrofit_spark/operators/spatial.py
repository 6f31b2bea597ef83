"""Effects of areas that are smoothed over their neighbours: the structured spatial term of a count model.

Areas are hexagon cells of grid.cell(), or any others with a table of neighbouring pairs. The term is an intrinsic conditional
autoregression: an area's effect is drawn to the mean of its neighbours' with a given strength. Its most likely values solve a sparse
linear system, found by conjugate gradients: each step is one join of the pairs with the last step's values and one written table;
the sums that steer it are observed as the table is written. The driver holds five numbers, never the areas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .ml import poisson_rates, poisson_tail
from .staging import release, staged

TOLERANCE, STEPS = 1e-10, 500


def ring(rings: int = 1) -> list[tuple[int, int]]:
    """Axial offsets of all cells that are up to so many rings away."""
    reach = range(-rings, rings + 1)
    return [(q, r) for q in reach for r in reach if (q, r) != (0, 0) and abs(q + r) <= rings]


def neighbouring_cells(cells: DataFrame, key: str = "hex_id", rings: int = 1) -> DataFrame:
    """cell, neighbour: both ways, of the hexagons that are in the table. Null keys have no place."""
    own = cells.where(F.col(key).isNotNull()).select(F.col(key).alias("cell")).distinct()
    parts = F.split("cell", ":")
    offsets = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(r).alias("r")) for q, r in ring(rings)))
    near = own.select("cell", parts[0].cast("long").alias("q"), parts[1].cast("long").alias("r"), F.explode(offsets).alias("by"))
    near = near.select("cell", F.concat_ws(":", (F.col("q") + F.col("by.q")).cast("string"), (F.col("r") + F.col("by.r")).cast("string")).alias("neighbour"))
    return near.join(own.withColumnRenamed("cell", "neighbour"), "neighbour", "left_semi").select("cell", "neighbour")


def _observed(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """The frame staged, with sums over its rows that are taken on the way."""
    watch = Observation()
    out = staged(df.observe(watch, *(F.sum(x).alias(n) for n, x in sums.items())))
    return out, {n: float(x or 0.0) for n, x in watch.get.items()}


def solve_smooth(system: DataFrame, pairs: DataFrame, strength: float, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """cell, effect: solves weight * effect + strength * (sum over neighbours of own effect - theirs) = pull.

    system: cell, weight (0 or more), pull. pairs: cell, neighbour, both ways. Ends when the residual is below `tolerance` of the pull, or
    raises after `steps` steps. An area with neither weight nor neighbours has the effect 0.
    """
    degree = pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    ready = system.join(degree, "cell", "left").select("cell", (F.col("weight") + strength * F.coalesce("n", F.lit(0))).cast("double").alias("diagonal"), F.col("pull").cast("double").alias("rest"))
    scaled = F.when(F.col("diagonal") > 0, F.col("rest") / F.col("diagonal")).otherwise(0.0)
    state, sums = _observed(ready.withColumns({"effect": F.lit(0.0), "way": scaled}), size=scaled * F.col("rest"))
    pairs, first, now, turned_from = staged(pairs.select("cell", "neighbour")), sums["size"], sums["size"], state
    for _ in range(steps):
        if now <= tolerance**2 * first or not now:
            return state.select("cell", "effect")
        theirs = pairs.join(state.select(F.col("cell").alias("neighbour"), F.col("way").alias("theirs")), "neighbour").groupBy("cell").agg(F.sum("theirs").alias("theirs"))
        turned = state.join(theirs, "cell", "left").withColumn("turned", F.col("diagonal") * F.col("way") - strength * F.coalesce("theirs", F.lit(0.0))).drop("theirs")
        before, (turned, sums) = turned_from, _observed(turned, along=F.col("way") * F.col("turned"))
        release(before)
        turned_from = turned
        if sums["along"] <= 0:  # what is left lies where the system says nothing
            return state.select("cell", "effect")
        step = now / sums["along"]
        moved = turned.withColumns({"effect": F.col("effect") + step * F.col("way"), "rest": F.col("rest") - step * F.col("turned")}).drop("turned")
        size = moved.agg(F.sum(scaled * F.col("rest"))).head()[0] or 0.0
        state, now = moved.withColumn("way", scaled + (size / now) * F.col("way")), size
    raise RuntimeError(f"no solution to {tolerance} in {steps} steps")


def smoothed_effects(areas: DataFrame, pairs: DataFrame, key: str, value: str, weight: str, strength: float) -> DataFrame:
    """key, effect: values smoothed over neighbouring areas, least in weight * (value - effect)^2 + strength * (effect - neighbour's)^2 summed over areas and pairs.

    A null value or weight is one without weight: its area takes what its neighbours say. Null keys don't count; a repeated one counts with the sum of its weights.
    """
    own = F.when(F.col(value).isNotNull(), F.coalesce(F.col(weight), F.lit(0)).cast("double")).otherwise(0.0)
    system = areas.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("cell")).agg(F.sum(own).alias("weight"), F.coalesce(F.sum(own * F.col(value)), F.lit(0.0)).alias("pull"))
    return solve_smooth(staged(system), pairs, strength).withColumnRenamed("cell", key)


def spatial_poisson(areas: DataFrame, pairs: DataFrame, key: str, count: str, exposure: str, features: list[str], strength: float, rounds: int = 20, threshold: float | None = None) -> DataFrame:
    """Areas with `expected` and `exceedance` of a Poisson regression with offset and a spatial term, and the term itself as `effect`.

    The regression gives each area's rate without the term; the term's most likely values given these rates are found by Newton's method, whose
    every round is one sparse system. Rounds end when no effect moves by more than 1e-8. A positive effect is an area that, with its neighbours, has more than
    its features explain. Keys must be unique and not null.
    """
    plain = poisson_rates(areas, count, exposure, features).drop("exceedance").withColumnsRenamed({"expected": "__plain"})
    state = staged(plain.withColumn("effect", F.lit(0.0)))
    for _ in range(rounds):
        mean = F.col("__plain") * F.exp("effect")
        system = state.select(F.col(key).alias("cell"), mean.alias("weight"), (mean * F.col("effect") + F.col(count) - mean).alias("pull"))
        found = solve_smooth(system, pairs, strength).select(F.col("cell").alias("__cell"), F.col("effect").alias("__next"))
        state, sums = _observed_most(state.join(found, F.col(key) == F.col("__cell")).drop("__cell"), F.abs(F.col("__next") - F.col("effect")))
        state = state.withColumn("effect", F.col("__next")).drop("__next")
        if sums < 1e-8:
            break
    bound = F.col(count) if threshold is None else F.floor(F.col(exposure) * F.lit(float(threshold)))
    out = state.withColumn("expected", F.col("__plain") * F.exp("effect")).drop("__plain")
    return out.withColumn("exceedance", poisson_tail(bound, F.col("expected")))


def _observed_most(df: DataFrame, what: Column) -> tuple[DataFrame, float]:
    watch = Observation()
    out = staged(df.observe(watch, F.max(what).alias("most")))
    return out, float(watch.get["most"] or 0.0)
