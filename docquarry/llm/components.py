"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; labels and edges stay in the cluster, and every round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import write_shared


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v."""
    around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if not large:  # neighbours below u, and u itself, go to the least of them
        low = edges.join(least, "u")
        out = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    else:  # neighbours above u go to the least around u
        out = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _settled(now: DataFrame) -> bool:
    """Whether edges (u, v) are stars: each u has one v, and no v is a u.  Then every v is the least of its component."""
    ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
    return seen.where("up > 1 or (up = 1 and n > 1)").limit(1).isEmpty()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of an edge (a, b) table of longs; root is the least node of the component."""
    now = write_shared(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    while not _settled(now):
        if not rounds:
            raise RuntimeError("components did not settle")
        now, rounds = write_shared(_stars(_stars(now, True), False), "stars"), rounds - 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def extend(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after more edges (a, b): only the components that they touch are worked on."""
    side = lambda e, c: e.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    ends = side(side(edges, "a"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
    over = components(ends)
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return write_shared(moved.unionAll(over.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")
