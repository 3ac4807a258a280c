"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import discard, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node. Null ends and self-loops link nothing.

    Each round links every node to the least label among its neighbours and then jumps to the label of that label, so rounds grow
    with the logarithm of the diameter. The aggregate over a hub's edges combines map-side; nothing is collected."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = stage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        step = label.join(near, "node").select("node", "component", F.least("component", "other").alias("new"))
        jump = label.select(F.col("node").alias("new"), F.col("component").alias("further"))
        moved = stage(step.join(jump, "new", "left").select("node", F.least("new", "further").alias("component"), (F.least("new", "further") != F.col("component")).alias("changed")), "labels")
        discard(label)
        label = moved
        if not moved.where("changed").limit(1).count():
            discard(both)
            return moved.select("node", "component")
