"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges`` (u, v) of any ordered type to (u, v): v is the least node of u's component.

    Nodes that are least in their component have no row; self-loops and nulls
    are ignored; no edges give no rows. Every round is written to the shared
    folder and only two numbers come to the driver. Rows of a round never
    outnumber twice the edges, whatever the degree of a node: minima are
    combined before the shuffle, and each edge meets one minimum.
    """
    table, seen = Table(edges.where("u <> v").select("u", "v"), "edges"), None
    for _ in range(max_rounds):
        after = Table(_small_star(_large_star(table.df)), "stars")
        table.drop()
        table = after
        state = table.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return table.df
        seen = state
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
