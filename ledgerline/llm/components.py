"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, temporary


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every end of the links a, b (bigint).

    Each turn, a node takes the smallest label among itself, its neighbours and the node that its
    label names; the last step doubles the reach, so long chains take a logarithm of turns. Turns end
    when no label changes. Labels are tables in the shared folder; nothing but a count is collected.
    """
    spark = links.sparkSession
    with temporary(spark) as keep:
        both = links.select("a", "b").union(links.select("b", "a"))
        edges = materialize(both.where("a is not null and b is not null").distinct(), "edges")
        labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
        while True:
            near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
            closer = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
            up = labels.select(F.col("node").alias("mid"), F.col("component").alias("up"))
            turned = materialize(closer.join(up, "mid").select("node", "old", F.least("mid", "up").alias("component")), "labels")
            if turned.where("component != old").isEmpty():
                return keep(turned).select("node", "component")
            labels = turned.select("node", "component")
