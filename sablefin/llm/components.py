"""Connected components over a table of links; nothing is collected to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablefin.llm.shared import drop, materialise


def components(links: DataFrame) -> DataFrame:
    """(v, label, and an old label) for each end of the links (a, b); label is the smallest vertex reachable.

    Each round takes the smallest label among neighbours and then the label of one's label, so long
    chains halve. Every round is written to the shared folder; no groups are gathered.
    """
    ends = materialise(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "links")
    labels = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("v"), "label")
    while True:
        near = ends.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = step.select(F.col("v").alias("p"), F.col("label").alias("up"))
        step = materialise(step.join(up, F.col("label") == F.col("p"), "left").select("v", "old", F.coalesce("up", "label").alias("label")), "labels")
        drop(labels)
        labels = step
        if step.filter("label != old").isEmpty():
            drop(ends)
            return labels
