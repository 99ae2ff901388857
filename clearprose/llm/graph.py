"""Connected components of large edge tables, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearprose.llm.tables import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the smallest node it reaches.

    Each round points every node at its smallest neighbour (or itself), follows the
    pointers to their ends by doubling, and contracts the edges to those ends; the
    nodes left at least halve in a round. All steps are joins and partial
    aggregations of written tables, so a node with very many edges is split by
    adaptive execution, and a lost executor costs one step.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    pairs = work.written(pairs, "edges")
    labels = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b"))
        ends = work.written(lowest.select("id", F.least("id", "b").alias("end")), "ends")
        while True:
            far = ends.select(F.col("id").alias("end"), F.col("end").alias("far"))
            further = work.written(ends.join(far, "end").select("id", F.col("far").alias("end"), (F.col("far") != F.col("end")).alias("moved")), "ends")
            moved = not further.filter("moved").isEmpty()
            ends = further.drop("moved")
            ends._work_path = further._work_path
            if not moved:
                break
        a = ends.select(F.col("id").alias("a"), F.col("end").alias("ea"))
        b = ends.select(F.col("id").alias("b"), F.col("end").alias("eb"))
        inner = pairs.join(a, "a").join(b, "b").select(F.least("ea", "eb").alias("a"), F.greatest("ea", "eb").alias("b"))
        pairs = work.written(inner.filter("a < b").distinct(), "edges")
        if labels is None:
            labels = ends.select("id", F.col("end").alias("component"))
        else:
            step = ends.select(F.col("id").alias("component"), "end")
            labels = work.written(labels.join(step, "component", "left").select("id", F.coalesce("end", "component").alias("component")), "labels")
    if labels is None:
        labels = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    return labels
