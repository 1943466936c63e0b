"""Connected components of a link table, as rounds of joins; neither links nor labels reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links(a, b): the smallest node reachable. No links: no rows.

    Every round each node takes the smallest label beside it and then its label's label, so that paths shorten by
    half; a hub's links are pre-aggregated before the shuffle. Each round is written to the shared folder; rounds go on until
    no label changes.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = (
            both.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("c").alias("c"))
        )
        taken = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        up = label.select(F.col("node").alias("component"), F.col("component").alias("up"))
        # the component is itself a node, so its own label is a shorter way
        new = stage(
            taken.join(up, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), F.col("old"))
        )
        done = new.where("component <> old").isEmpty()
        label = new.select("node", "component")
        if done:
            return label
