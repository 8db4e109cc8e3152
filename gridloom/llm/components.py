"""Connected components over a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialise


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node around it."""
    around = _both_ways(links)
    # written first, so that both sides of the join are plain exchanges and a hub can be split
    least = materialise(
        around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least"
    )
    return around.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its neighbours below are linked to the least of those."""
    least = materialise(links.groupBy("hi").agg(F.min("lo").alias("m")), "least")
    moved = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo")))


def _is_forest_of_stars(links: DataFrame) -> bool:
    ends = links.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        links.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    bad = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
    return bad.isEmpty()


def component_stars(links: DataFrame) -> DataFrame:
    """``hi, lo`` links between comparable nodes become one star per component around its least node.

    Links may repeat, point either way or lead from a node to itself. Every round writes its table to the shared folder and asks
    one question about it; the number of rounds grows with the logarithm of the longest path. Roots have no row of
    their own. No links give no rows.
    """
    stars = materialise(
        links.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "links"
    )
    while not _is_forest_of_stars(stars):
        large = materialise(_large_star(stars).distinct(), "large")
        stars = materialise(_small_star(large).distinct(), "small")
    return stars
