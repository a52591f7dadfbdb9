"""Connected components over an edge table, by min-label contraction with alternating stars.

Each round replaces every edge by edges towards smaller nodes (large star, then small star), so a component
becomes one star around its smallest node after a number of rounds that grows with the logarithm of its size;
rounds go on until nothing changes, which always comes (labels only ever get smaller). Groups are only ever
reduced by ``min`` with partial aggregation and joined back by (node, salt), so that the centre of a star with
very many leaves is dealt over many tasks; no neighbourhood is gathered into one. Each round's edges are written
to the shared folder, which ends the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.shared import each_salt, removed, salt, salts, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Large star links the larger neighbours of each node to its least neighbour, small star the others and itself."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = each_salt(both.groupBy("u").agg(F.min("v").alias("m"), salts("v").alias("salts")).select("u", F.least("u", "m").alias("m"), "salts"))
        out = both.where("v > u").withColumn("salt", salt("v")).join(least, ["u", "salt"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = each_salt(edges.groupBy("a").agg(F.min("b").alias("m"), salts("b").alias("salts")))
        out = edges.withColumn("salt", salt("b")).join(least, ["a", "salt"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b; any order, loops allowed); root is the least node reachable."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    was = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        was, old = mark, now
        now = stored(_star(_star(old, True), False), "edges")
        removed(old)
