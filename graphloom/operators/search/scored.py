"""From scores (query_id, node, score) of a trained model to communities."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...plans.iterate import stored
from ..structure import adjacency, bfs, components, core_numbers


def threshold_bfs(edges: DataFrame, queries: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Vertices reached from the query through vertices whose score is at least ``threshold``; the query itself is always in."""
    good = scores.filter(F.col("score") >= threshold).select("query_id", "node").unionByName(queries.select("query_id", "node")).distinct()
    good = stored(good, "good")
    inner = edges.join(good.select("query_id", F.col("node").alias("u")), "u").join(good.select("query_id", F.col("node").alias("v")), ["query_id", "v"])
    label = components(inner.select("query_id", "u", "v"), good, by=["query_id"])
    hit = queries.select("query_id", "node").join(label, ["query_id", "node"]).select("query_id", "component").distinct()
    return label.join(hit, ["query_id", "component"]).select("query_id", "node")


def best_prefix(scores: DataFrame, most: int = 10_000) -> DataFrame:
    """``query_id, node``: of the vertices by falling score, the prefix that maximises (sum of scores - size x mean score) / sqrt(size), ``most`` vertices or half of all at most."""
    w = Window.partitionBy("query_id")
    order = w.orderBy(F.desc("score"), "node")
    ranked = scores.select("query_id", "node", "score", F.row_number().over(order).alias("r"), F.sum("score").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.avg("score").over(w).alias("mean"), F.count(F.lit(1)).over(w).alias("n"))
    allowed = F.col("r") <= F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("n") / 2)))
    gain = F.when(allowed, (F.col("s") - F.col("r") * F.col("mean")) / F.sqrt(F.col("r").cast("double")))
    best = ranked.withColumn("gain", gain).withColumn("top", F.max(F.round(F.col("gain"), 12)).over(w))
    best = best.withColumn("cut", F.min(F.when(F.round(F.col("gain"), 12) == F.col("top"), F.col("r"))).over(w))
    return best.filter("r <= cut").select("query_id", "node")


def prefix_component(edges: DataFrame, queries: DataFrame, scores: DataFrame) -> DataFrame:
    """The best prefix, then its connected part that holds the query (the query alone if none does)."""
    chosen = stored(best_prefix(scores).unionByName(queries.select("query_id", "node")).distinct(), "prefix")
    inner = edges.join(chosen.select("query_id", F.col("node").alias("u")), "u").join(chosen.select("query_id", F.col("node").alias("v")), ["query_id", "v"])
    label = stored(components(inner.select("query_id", "u", "v"), chosen, by=["query_id"]), "parts")
    need = queries.groupBy("query_id").agg(F.count_distinct("node").alias("need"))
    hit = queries.join(label, ["query_id", "node"]).groupBy("query_id", "component").agg(F.count_distinct("node").alias("has")).join(need, "query_id").filter("has = need")
    found = label.join(hit.select("query_id", "component"), ["query_id", "component"]).select("query_id", "node")
    return found.unionByName(queries.select("query_id", "node").join(found.select("query_id").distinct(), "query_id", "left_anti"))


def core_hops(edges: DataFrame, queries: DataFrame, cores: DataFrame | None = None, hops: int = 2) -> DataFrame:
    """Vertices within ``hops`` steps whose score (core number, or any other given as ``core``) is at least that of the query."""
    cores = stored(core_numbers(edges), "cores") if cores is None else cores
    near = bfs(edges, queries.select("query_id", "node"), limit=hops, by=["query_id"])
    least = queries.join(cores, "node").groupBy("query_id").agg(F.min("core").alias("least"))
    return near.join(cores, "node").join(least, "query_id").filter("core >= least").select("query_id", "node").distinct()


def cluster_expand(edges: DataFrame, queries: DataFrame, scores: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """Scores of at least ``threshold`` in the query's cluster and its border, expanding into a neighbouring cluster when a border vertex of it qualifies."""
    adj = stored(adjacency(edges), "adj")
    part = clusters.select("node", "cluster")
    good = stored(scores.filter(F.col("score") >= threshold).join(part, "node").select("query_id", "node", "cluster"), "good")
    active = stored(queries.join(part, "node").select("query_id", "cluster").distinct(), "active")
    front = active
    while True:
        inside = front.join(part, "cluster").select("query_id", F.col("node").alias("s"))
        border = inside.join(adj, "s").select("query_id", F.col("d").alias("node")).distinct().join(good, ["query_id", "node"]).select("query_id", "cluster").distinct()
        front = stored(border.join(active, ["query_id", "cluster"], "left_anti"), "front")
        if front.isEmpty():
            break
        active = stored(active.unionByName(front), "active")
    return good.join(active, ["query_id", "cluster"]).select("query_id", "node").unionByName(queries.select("query_id", "node")).distinct()


def heap_growth(edges: DataFrame, queries: DataFrame, scores: DataFrame, top: int | None = None, threshold: float | None = None, free: int = 3, size: int = 500, mean: bool = False) -> DataFrame:
    """Grows by the best-scored neighbour, the least id of equals, until there is none.

    ``top``: to so many vertices. ``threshold``: while scores reach it. ``mean``: while a score reaches the sum of the scores that joined (those of the query don't count) over the number of
    members. The first ``free`` vertices join regardless of both.
    """
    from .local import _grouped

    def grow(nbrs, full, query, m, score):
        c, joined, shell = set(query), 0.0, []
        seen, fresh = set(query), list(query)
        while top is None or len(c) < top:
            for v in fresh:
                for w in nbrs.every(v) - seen:
                    seen.add(w)
                    heapq.heappush(shell, (-score.get(w, 0.0), w))
            if not shell:
                break
            x, w = -shell[0][0], heapq.heappop(shell)[1]
            if len(c) >= free and (threshold is not None and x < threshold or mean and x < joined / len(c)):
                break
            c.add(w)
            joined, fresh = joined + x, [w]
        return c

    return _grouped(edges, queries, grow, size, scores)


def swap_growth(edges: DataFrame, queries: DataFrame, scores: DataFrame, top: int = 30, size: int = 500) -> DataFrame:
    """The first ``top`` vertices in breadth order, then members with low scores give way to adjacent vertices with higher ones while the set stays connected to the query."""
    from .local import _grouped

    def grow(nbrs, full, query, m, score):
        order, seen = list(query), set(query)
        for v in order:
            if len(order) >= top:
                break
            for w in sorted(nbrs.every(v)):
                if w not in seen:
                    seen.add(w)
                    order.append(w)
        c, q = set(order[:top]), set(query)

        def whole(c):
            part, stack = {query[0]}, [query[0]]
            while stack:
                for w in nbrs[stack.pop()] & c - part:
                    part.add(w)
                    stack.append(w)
            return c <= part or len(part) == len(c)

        while True:  # the sum of scores rises with every swap
            shell = {w for v in c for w in nbrs.every(v)} - c
            moved = False
            for w in sorted(shell, key=lambda x: (-score.get(x, 0.0), x)):
                for v in sorted(c - q, key=lambda x: (score.get(x, 0.0), x)):
                    if score.get(v, 0.0) >= score.get(w, 0.0):
                        break
                    if whole((c - {v}) | {w}):
                        c = (c - {v}) | {w}
                        moved = True
                        break
                if moved:
                    break
            if not moved:
                break
        return c

    return _grouped(edges, queries, grow, size, scores)


def sweep_cut(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """``node, pos, vol, cut, conductance`` of every prefix by falling rank / degree: prefix sums of volume, edges counted at their later end."""
    from .structural import Window as W
    from ..structure import degrees

    ordered = ranks.join(degrees(edges), "node").withColumn("x", F.round(F.col("rank") / F.col("degree"), 12))
    every = W.partitionBy(F.lit(0))  # the support of one query's ranks
    placed = stored(ordered.select("node", "degree", F.row_number().over(every.orderBy(F.desc("x"), "node")).alias("pos")), "sweep")
    a, b = placed.select(F.col("node").alias("u"), F.col("pos").alias("pu")), placed.select(F.col("node").alias("v"), F.col("pos").alias("pv"))
    closed = edges.join(a, "u").join(b, "v").groupBy(F.greatest("pu", "pv").alias("pos")).agg(F.count(F.lit(1)).alias("inner"))
    upto = every.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    m2 = 2 * edges.count()
    out = placed.join(closed, "pos", "left").select("node", "pos", F.sum("degree").over(upto).alias("vol"), F.sum(F.coalesce("inner", F.lit(0))).over(upto).alias("inner"))
    cut = F.col("vol") - 2 * F.col("inner")
    side = F.least(F.col("vol"), m2 - F.col("vol"))
    return out.select("node", "pos", "vol", cut.alias("cut"), F.when(side > 0, cut / side).otherwise(0.0).alias("conductance"))
