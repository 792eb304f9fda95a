"""Connected components of a table of links, by alternating large and small stars.

In a large star every node links its larger neighbours to the smallest node it sees; in a small star it
links its smaller neighbours and itself to the smallest. Both keep the components, the number of links never
grows, and they end in one star per component after a few rounds. Smallest neighbours come from a partial
aggregation and are joined back with salted hot nodes; each round is a checkpoint, so a lost executor costs
at most one round. Nothing but the answer whether the links are stars reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.segments import materialize
from .spread import attach


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round on links (a, b) with a > b."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        both = materialize(both)
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    seen = attach(both, least, ["u"], ["v"])
    if large:
        found = seen.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        found = seen.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return materialize(found.filter(F.col("a") > F.col("b")).distinct())


def _is_star(links: DataFrame) -> bool:
    """Whether every node that has a smaller neighbour has one only, which has none itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node that is linked and not the smallest.
    `links` has two long columns a and b; order, repeats and loops do not matter."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    links = materialize(links.select(a.alias("a"), b.alias("b")).filter(F.col("a") > F.col("b")).distinct())
    while not _is_star(links):
        links = _star(_star(links, large=True), large=False)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
