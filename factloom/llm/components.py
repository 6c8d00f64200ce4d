"""Connected components of a link table, by smallest labels and pointer jumping, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node, comp for every end of links (a, b); comp is the smallest node of its component.

    Each round a node takes the smallest label among its own, its neighbours' and that of the node its label names.
    Labels are aggregated on the map side, so a node with very many links makes no hot task; rounds grow with the
    logarithm of a component's width.  No link or label reaches the driver.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        closer = labels.join(seen, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = closer.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("far", "comp")).alias("comp"), "old")
        new = materialize(new, "labels")
        discard(labels)
        moved = new.where("comp != old").limit(1).count()
        labels = new.drop("old")
        if not moved:
            return labels
