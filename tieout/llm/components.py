"""Connected components of a graph given as links, by alternating star steps.

In a large-star step every node hangs its greater neighbours on its least neighbour, in
a small-star step its lesser ones; the links shrink to stars in a logarithmic number of
rounds (Kiveris et al., Connected Components in MapReduce and Beyond, 2014). Each round
is written to the shared folder, so plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star-least")
    met = both.join(least, "a")  # written first: a hub's rows can be split at the join
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, part): the least node of the component of every node that has a link."""
    now = cut_lineage(links.select("a", "b").where("a != b").distinct(), "star")
    before = None
    while True:
        now = cut_lineage(_star(_star(now, True), False), "star")
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("part"))
    return stars.unionByName(stars.select(F.col("part").alias("node"), "part").distinct())
