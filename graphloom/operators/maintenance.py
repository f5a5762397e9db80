"""Core numbers kept current under added and removed edges: only vertices that can change, and what their change touches, are looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import discard, stored
from .structure import adjacency, h_index


def _candidates(adj: DataFrame, ranges: DataFrame, added: DataFrame) -> DataFrame:
    """``node``: the vertices whose core may rise.

    Vertices that rise to k hang together, through vertices that rise to k too, with an end of an added edge. So from those ends the
    search goes on from vertex to neighbour where the ranges (core, most] of new cores overlap.
    """
    ends = added.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    seen = stored(ends.join(ranges, "node").filter("most > core").select("node", "core", "most"), "risers")
    front, rounds = seen, 0
    while not front.isEmpty():
        rounds += 1
        near = front.select(F.col("node").alias("s"), F.col("core").alias("low"), F.col("most").alias("high")).join(adj, "s")
        reach = near.join(ranges.withColumnRenamed("node", "d"), "d").filter("most > core and most > low and high > core")
        fresh = reach.select(F.col("d").alias("node"), "core", "most").distinct().join(seen.select("node"), "node", "left_anti")
        front = stored(fresh, "risers")
        seen = seen.unionByName(front)
        if rounds % 8 == 0:
            seen = stored(seen, "risers")
    return seen.select("node", "most")


def updated_cores(edges: DataFrame, cores: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """``node, core`` of the graph ``edges`` (u, v), which came from one with ``cores`` (node, core) by ``added`` and ``removed`` edges.

    If no vertex is an end of more than b added edges, no core rises by more than b. From such upper bounds h-indices fall to the new
    cores; a round looks only at vertices of which a neighbour has fallen. ``added`` edges are in ``edges`` and were not there before, ``removed`` ones are not.
    Vertices of ``cores`` that have lost all edges have core 0. Repeated deltas, and empty ones, are allowed.
    """
    adj = stored(adjacency(edges), "adj")
    added = added.select("u", "v").distinct()
    most = added.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    size = adj.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    known = cores.select("node", "core").join(size, "node", "full").select("node", F.coalesce("core", F.lit(0)).cast("long").alias("core"), F.coalesce("degree", F.lit(0)).alias("degree"))
    ranges = stored(known.select("node", "core", F.least(F.col("core") + most, "degree").alias("most")), "ranges")
    rising = stored(_candidates(adj, ranges, added), "rising")
    base = stored(ranges.join(rising.select("node", F.col("most").alias("up")), "node", "left").select("node", F.coalesce("up", "core").alias("value")), "bounds")  # a lost edge lowers its ends in a round, so that their neighbours hear of it
    lost = removed.select(F.explode(F.array("u", "v")).alias("node"))
    active = stored(rising.select("node").unionByName(lost).distinct().join(base.select("node"), "node", "left_semi"), "active")
    # What has fallen since; small beside ``base``, which is read and not written again.
    fallen = stored(base.limit(0), "fallen")
    while not active.isEmpty():
        now = base.join(fallen.withColumnRenamed("value", "less"), "node", "left").select("node", F.coalesce("less", "value").alias("value"))
        asked = adj.join(active.withColumnRenamed("node", "s"), "s", "left_semi")
        found = now.join(active, "node", "left_semi").join(h_index(asked, now).withColumnRenamed("value", "h"), "node", "left")
        moved = stored(found.select("node", F.coalesce("h", F.lit(0)).alias("h"), "value").filter("h < value").select("node", F.col("h").alias("value")), "moved")
        after = stored(fallen.join(moved.select("node"), "node", "left_anti").unionByName(moved), "fallen")
        touched = stored(adj.join(moved.select(F.col("node").alias("s")), "s").select(F.col("d").alias("node")).distinct(), "active")
        for old in (fallen, active, moved):
            discard(old)
        fallen, active = after, touched
    return base.join(fallen.withColumnRenamed("value", "less"), "node", "left").select("node", F.coalesce("less", "value").alias("core"))
