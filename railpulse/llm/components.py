"""Connected components of a graph of links, as joins and groupings.

Large-star and small-star steps in turn: every node hands its larger neighbours, then its
smaller ones, over to the smallest node it knows. Links never grow in number, and a
node with very many links costs each map task one row in the groupings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.operators.durable import keep


def _are_stars(links: DataFrame) -> bool:
    """Whether every node either has one smaller neighbour, without others, or is itself the smallest of its neighbours."""
    ends = links.select("u", F.lit(1).alias("below")).union(links.select("v", F.lit(0)))
    counted = ends.groupBy("u").agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("n"))
    return counted.where("below > 0 AND n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that ``links`` (two columns of one ordered type)
    name; the component is its smallest node. Loops, repeats and NULLs do not matter."""
    a, b = links.columns
    now = keep(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    # Links that are stars stay as they are.
    while not _are_stars(now):
        both = now.union(now.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("at"), F.least("u", "m").alias("m")
        )
        large = (
            both.join(lowest, F.col("u") == F.col("at")).where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = keep(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), "m")
        small = large.join(least, F.col("u") == F.col("at"))
        now = keep(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("at", "m")).distinct()
        )
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct()
    )
