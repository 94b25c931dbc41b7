"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(links: DataFrame, *, rounds: int | None = None) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (a, b) reaches.

    Every round takes the smallest label among a node and its neighbours, then the label of
    that label; a round's labels are written, so nothing is computed twice, and the round before goes. A hub's
    links are the streamed side of a sort-merge join, which Spark splits when it is skewed. ``rounds`` ends
    early with labels that may still be too large. Written.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))
    labels = written(labels)
    done = 0
    while rounds is None or done < rounds:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        up = labels.select(F.col("node").alias("u"), F.col("label").alias("over"))
        new = written(
            own.join(up, F.col("label") == F.col("u"), "left").select("node", "old", F.least("label", F.coalesce("over", "label")).alias("label"))
        )
        drop(labels)
        labels = new
        done += 1
        if rounds is None and new.where("label <> old").isEmpty():
            break
    out = written(labels.select("node", "label"))
    drop(both, labels)
    return out
