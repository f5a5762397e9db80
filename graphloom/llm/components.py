"""Connected components by contraction, as joins and aggregates on link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of ``links`` (a, b); equal roots mean connected.

    Each round every vertex moves to whichever of itself and its neighbours has the least hash of that round, links follow,
    and loops and repeats go. No two neighbours both stay, so a fixed share of the remaining vertices vanishes each round, however
    long the chains are. Rounds are written to the shared folder; a hub's links are only ever aggregated by partial minimum.
    """

    def ordered(a, b):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    left = stored(links.filter("a <> b").select(*ordered(F.col("a"), F.col("b"))).distinct(), "links")
    labels, round_no = None, 0
    while True:
        both = left.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("w")))
        rank = lambda c, r=round_no: F.struct(F.xxhash64(F.lit(r), c), c.alias("x"))
        moves = both.groupBy("v").agg(F.min(rank(F.col("w"))).alias("m")).select("v", F.least(rank(F.col("v")), F.col("m"))["x"].alias("p"))
        moves = stored(moves, "moves")
        if labels is None:
            labels = moves.withColumnRenamed("p", "root")
        else:
            labels = labels.join(moves.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
        one, two = moves.select(F.col("v").alias("a"), F.col("p").alias("pa")), moves.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        rest = stored(left.join(one, "a").join(two, "b").filter("pa <> pb").select(*ordered(F.col("pa"), F.col("pb"))).distinct(), "links")
        discard(left)
        left, round_no = rest, round_no + 1
        if left.isEmpty():
            return labels
        if round_no % 4 == 0:
            labels = stored(labels, "labels")
