"""Connected components by minimum labels with pointer jumping."""

from pyspark.sql import DataFrame, functions as F

from ..sources.store import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over ``edges(a, b)``; O(log n) rounds in practice."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        offered = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("offer"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = label.join(offered, "id").join(jump, "component", "left").select("id", F.col("component").alias("old"), F.least("component", "offer", "further").alias("component"))
        new = written(new, "labels")
        moved = new.where("component <> old").limit(1).count()
        label = new.select("id", "component")
        if not moved:
            return label
