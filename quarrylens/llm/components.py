"""Connected components by minimum labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, store


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) links of longs to (id, component): the least id each id reaches.

    Self-links, repeated links and nulls are allowed (nulls are ignored). Each round takes the least label among the
    neighbours, pre-aggregated before the shuffle, and then follows the label's own label; every round is written to
    the shared folder, so no lineage grows and nothing is collected but the number of changed labels.
    """
    both = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    both = store(both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = store(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    while True:
        near = both.join(labels.select("id", "component"), both.src == labels.id).select(both.dst.alias("id"), "component")
        least = near.union(labels.select("id", "component")).groupBy("id").agg(F.min("component").alias("component"))
        least = store(least, "labels")
        up = least.select(F.col("id").alias("up"), F.col("component").alias("top"))
        jumped = least.join(up, least.component == up.up, "left").select("id", F.least("component", "top").alias("component"))
        old = labels.select("id", F.col("component").alias("old"))
        jumped = store(jumped.join(old, "id", "left").select("id", "component", (F.col("old") != F.col("component")).alias("changed")), "labels")
        forget(labels, least)
        if jumped.where("changed").limit(1).count() == 0:
            forget(both)
            found = jumped.select("id", "component")
            found.stored_at = jumped.stored_at
            return found
        labels = jumped
