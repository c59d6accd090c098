"""Connected components by alternating large and small stars, each round a shuffle by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import saved, shared_folder


#: Edges that a partition of a checkpoint holds at least, while there are fewer than Spark's own number of partitions.
EDGES_PER_PARTITION = 100_000


def _cut(df: DataFrame, edges: int) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder; few edges go to few partitions."""
    shared_folder(df.sparkSession)
    return df.coalesce(1 + edges // EDGES_PER_PARTITION).checkpoint(True)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node reachable.

    Every round, each node's larger neighbours are linked to its smallest one
    (large star), then its smaller ones are (small star), until nothing changes;
    the number of rounds grows with the logarithm of the longest path.  Self
    loops and repeated edges are allowed, edges with a null end are left out; no
    edges give no rows.
    """
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = saved(now)
    edges, state = now.count(), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = _cut(small, edges)
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == tuple(found):
            break
        state = tuple(found)
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
