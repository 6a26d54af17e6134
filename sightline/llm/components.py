"""Connected components by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b: longs) → node, root (the least node of its component).

    Each round links every node's larger neighbours to its least one, then its smaller neighbours too; it ends when every
    component is a star, which is when no node with a lesser neighbour has another one. Only minima and counts are gathered
    for a node, never its neighbours. The minima are written before edges are joined with them, so that both sides of a join
    come straight from a shuffle, where Spark splits a hub's edges over several tasks. Rounds grow with the logarithm of the
    size of a component; lost executors cost a round at most.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        if least.filter("m < a and n > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(large.filter("a > b").distinct(), "large-star")
        down = written(small.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = small.join(down, "a")
        star = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = written(star, "edges")
    raise RuntimeError("the components have not settled")
