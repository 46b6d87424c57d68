"""Connected components of a table of links, as DataFrame rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claimed, drop, kept, written


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """links: a, b (any order).  Returns node, label: the smallest node reachable, for every node that has a link.

    A round gives each node the least label among its own and its neighbours' (aggregated before the exchange), then jumps to that
    label's label, so a path of n nodes takes about log n rounds and a star two.  A hub's links and the nodes of one label stand on the large
    side of their joins, whose other side has one row a key: skewed partitions of these joins are split at run time, and neither side is
    multiplied.  Each round is written to the shared folder, and the tables of the round before are deleted; what reaches the driver is one
    count.
    """
    spark = links.sparkSession
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst")
    both = kept(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), spark, "links")
    labels, path = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("label")).select("node", "label"), spark, "labels")
    for _ in range(limit):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near"))
        met = labels.join(near, labels["node"] == near["src"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        met, step = written(met, spark, "labels")
        # Only labels that have a smaller one themselves lead on.
        up = met.where("label <> node").select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = met.join(up, met["label"] == F.col("up"), "left")
        new, after = written(jumped.select("node", F.coalesce("up_label", "label").alias("label"), "was"), spark, "labels")
        drop(spark, path, step)
        changed = new.where("label <> was").limit(1).count()
        labels, path = new.select("node", "label"), after
        if not changed:
            claimed(path)
            return labels
    raise RuntimeError(f"components not closed after {limit} rounds")
