"""Connected components by shrinking labels and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b): the smallest node that edges lead to.

    A hub's edges are combined before they are dealt out, and the join that reads labels back can be split, so no task
    needs all edges of a node. Each round is a stored table; the number of rounds follows the logarithm of the longest
    path in all but contrived graphs.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        lower = labels.join(seen, "node").select("node", F.least("label", "seen").alias("low"), F.col("label").alias("old"))
        target = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        jumped = lower.join(target, "low").select("node", F.least("low", "next").alias("label"), "old")
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label != old").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
