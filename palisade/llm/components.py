"""Connected components of a graph of long ids, by min-label hops with pointer jumping; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); component is the least id that the node reaches.

    A round gives each node the least label among itself, its neighbours and its label's label.  A hub, or a label that many nodes
    share, is a key with one row on the other side: ``spread_join`` leaves its rows where they are.  Minima are taken within tasks first.
    """
    both = common.stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct(), "edges")
    # Each node with its degree, which tells hubs from others.
    labels = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n_left")).select("node", F.least("node", "m").alias("component"), "n_left"), "labels")
    ends, nodes = both.count(), labels.count()
    while True:
        near = common.spread_join(both, labels.withColumnRenamed("node", "b"), ["b"], "inner", ends).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        seen = common.stored(labels.join(near, "node").select("node", "n_left", F.col("component").alias("old"), F.least("component", "near").alias("component")), "seen")
        # A label is told to the node that it names, too: trees hook onto each other at their roots.  One row a node goes into that.
        told = seen.groupBy(F.col("old").alias("node")).agg(F.min("component").alias("told"), F.count(F.lit(1)).alias("n"))
        least = common.stored(seen.join(told, "node", "left").select("node", "n_left", "old", F.least("component", F.coalesce("told", "component")).alias("component")), "least")
        shared = least.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        up = shared.join(least.select(F.col("node").alias("component"), F.col("component").alias("up")), "component").select("component", "up", F.col("n").alias("n_left"))
        jumped = common.spread_join(least.withColumnRenamed("n_left", "degree"), up, ["component"], "inner", nodes)
        new = common.stored(jumped.select("node", F.least("component", "up").alias("component"), F.col("degree").alias("n_left"), "old"), "labels")
        moved = new.where("component != old").limit(1).count()
        for x in (labels, seen, least):
            common.unstore(x)
        labels = new
        if not moved:
            common.unstore(both)
            return labels.select("node", "component")
