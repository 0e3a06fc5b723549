"""Connected components by least labels with shortcuts, in DataFrame operations alone.

Each round, a node takes the least label among its neighbours', then its label's label. Both joins are plain equi-joins
of written tables, whose hot keys the engine can split, and the minima are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small


def components(links: DataFrame) -> DataFrame:
    """links: a long, b long, a row or more for each link -> (node, component), component being the least node reached.

    Rounds go on until no label falls: about the logarithm of the longest way. Null ends and loops link nothing.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"), F.lit(True).alias("changed")), "labels")
    n = labels.count()  # no round adds nodes, so lookups by node are broadcast while these are few
    while True:
        near = both.join(small(labels.select(F.col("node").alias("b"), "component"), n), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(small(near, n), F.col("node") == F.col("a")).select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        lower = materialize(lower, "labels-lower")
        jump = lower.select(F.col("node").alias("j"), F.col("component").alias("further"))
        labels = lower.join(small(jump, n), F.col("component") == F.col("j"), "left").select("node", F.least("component", "further").alias("component"), "was")
        labels = materialize(labels.select("node", "component", (F.col("component") != F.col("was")).alias("changed")), "labels")
        if not labels.where("changed").limit(1).count():
            return labels.select("node", "component")
