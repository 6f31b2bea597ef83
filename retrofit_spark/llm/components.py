"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label (the least node of its component) of every node of links (a, b), by least neighbouring labels and pointer jumping.

    Each round is written, so lost executors cost one round; all sums are made before they are shuffled.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = scratch.write(both, f"{name}-edges")
    labels = scratch.write(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "node"), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("near"))
        better = labels.join(near, labels["node"] == near["x"]).select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        better = scratch.write(better, f"{name}-{step}a")
        jump = better.select(F.col("node").alias("via"), F.col("label").alias("further"))
        after = better.join(jump, better["label"] == jump["via"], "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        done = better.where("moved").isEmpty()
        labels = scratch.write(after, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}a")
        if done:
            scratch.drop(f"{name}-edges")
            return labels
