"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is an aggregation to one row a node, which is written, and an equi-join with it, so the many rows of a node
with many partners are combined before they are shuffled, and Spark can split them in the join. Tables are cut off
their lineage every half round, so a lost executor costs half a round. Nothing but a yes or no reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import ready, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) of every node of links that has a partner; component is the smallest id that it reaches.

    Null ends and links of a node with itself are left out; repeated links count once. An empty table gives an empty one.
    """
    ready(links.sparkSession)
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        # settled when all links are stars around their smallest id: who has a smaller partner has no other
        if low.where("m < u and n > 1").isEmpty():
            break
        large = both.join(low.drop("n"), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct().checkpoint()
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.withColumnRenamed("m", "v")).distinct().checkpoint()
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
