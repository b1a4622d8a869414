"""Connected components of a distributed edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: comparable, not null); root is the smallest node of the component.

    Each round hangs, for every node, its larger neighbours on its smallest neighbour (large star) and then
    its smaller neighbours on the smallest (small star); the number of rounds grows with the logarithm of the
    nodes. The smallest neighbour comes from a groupBy with partial aggregation and goes back by a plain
    equi-join, so a hub of any degree is split by AQE, and nothing is collected. Each round is written to the
    shared folder, and the one before it deleted. Self links and repeated links are allowed; an empty table gives an empty table.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    (now, path), before = written(now, "edges"), None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        old = path
        now, path = written(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "edges")
        removed(edges.sparkSession, old)
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(now.groupBy("v").agg(F.min("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
