"""Connected components of a graph that no machine can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.shared import saved


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of each vertex of edges (a, b); component is the smallest id that it can reach.

    Each round gives a vertex the smallest label among its neighbours' and its own, then follows labels one step (so distances halve);
    a round's labels are a written table. The driver sees one number a round.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        told = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("told"))
        lower = labels.join(told, "id").select("id", F.least("component", "told").alias("label"), F.col("component").alias("was"))
        ahead = labels.select(F.col("id").alias("_id"), F.col("component").alias("ahead"))
        jumped = saved(lower.join(ahead, F.col("label") == F.col("_id"), "left").select("id", F.least("label", F.coalesce("ahead", "label")).alias("component"), "was"), "labels")
        changed = jumped.filter("component <> was").limit(1).count()
        labels = jumped.select("id", "component")
        if not changed:
            return labels
