"""Connected components of links, for work that must see all of a component and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.sources.tables import cut


def components(links: DataFrame, partition: list[str]) -> DataFrame:
    """(partition, node, component) of the ends of ``links`` (partition, a, b); component: the smallest node that can be reached.

    Every round, a node takes the smallest label around it, and then its label's own label, so that labels travel twice as far in each
    round. Labels only fall, and the rounds end when none does.
    """
    both = cut(links.select(*partition, "a", "b").unionByName(links.select(*partition, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(*partition, F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), [*partition, "b"]).groupBy(*partition, F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        step = labels.join(around, [*partition, "node"]).select(*partition, "node", "component", F.least("component", "_near").alias("_up"))
        further = labels.select(*partition, F.col("node").alias("_up"), F.col("component").alias("_top"))
        step = cut(step.join(further, [*partition, "_up"], "left").select(*partition, "node", "component", F.least("_up", F.coalesce("_top", "_up")).alias("_new")))
        moved = not step.filter(F.col("_new") != F.col("component")).isEmpty()
        labels = step.select(*partition, "node", F.col("_new").alias("component"))
        if not moved:
            return labels
