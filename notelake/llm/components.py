"""Connected components of an undirected graph held as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(v, component)``, the smallest vertex of each component.

    Every round takes the smallest label among neighbours and then follows labels
    once, so the distance that a label travels grows geometrically. Labels live in
    tables of the shared folder between rounds; all joins read such tables, which
    lets adaptive execution split a hub's rows. Empty edges give an empty result;
    loops and repeated edges are harmless; null ends are ignored.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    both = materialize(
        pairs.union(pairs.select("b", "a")).distinct(), "edges"
    )
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("l")), "labels")
    while True:
        sent = both.join(labels, both.a == labels.v).select(F.col("b").alias("v"), "l")
        near = materialize(sent.union(labels).groupBy("v").agg(F.min("l").alias("l")), "labels")
        far = near.select(F.col("v").alias("r"), F.col("l").alias("far"))
        jumped = materialize(
            near.join(far, near.l == far.r).select("v", F.least("l", "far").alias("l"), (F.col("far") < F.col("l")).alias("moved")),
            "labels",
        )
        old = labels.select("v", F.col("l").alias("before"))
        changed = jumped.where("moved").limit(1).count() or near.join(old, "v").where("l < before").limit(1).count()
        discard(near, labels)  # read by nothing from here on
        labels = jumped.select("v", "l")
        if not changed:
            discard(both)
            return labels.select("v", F.col("l").alias("component"))
