"""Query-biased density by peeling: the weakest vertex of every block goes, round after round, and the densest state of a query is its answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.iterate import parallelism, stored
from ..densest import TINY, density
from ..structure import components

#: Links of one query that a task peels block by block, at most; each of its rounds may look at all of them.
SMALL = 20_000


def blocks(near: dict, members: set) -> list[set]:
    """Vertex sets of the biconnected parts among ``members``, a bridge being one of two vertices. A vertex without neighbours there is in none."""
    place, low, out = {}, {}, []
    for start in sorted(members):
        if start in place:
            continue
        place[start] = low[start] = len(place)
        open_, path = [], [(start, None, iter(near[start] & members))]
        while path:
            v, parent, rest = path[-1]
            w = next(rest, None)
            if w is None:
                path.pop()
                if parent is None:
                    continue
                low[parent] = min(low[parent], low[v])
                if low[v] >= place[parent]:  # nothing from v on reaches above its parent
                    block = {parent}
                    while v not in block:
                        block.add(open_.pop())
                    out.append(block)
            elif w not in place:
                place[w] = low[w] = len(place)
                open_.append(w)
                path.append((w, v, iter(near[w] & members)))
            elif w != parent:
                low[v] = min(low[v], place[w])
    return out


def peel(near: dict, weight: dict, query: set, alpha: float) -> set:
    """The densest state on the way from all vertices to the query, the earliest of equals.

    Each round takes one vertex from each block, that with the least degree over weight (then the least id), never one of the query. Where none of them is at most ``alpha`` times the
    density, only the weakest goes. Only blocks that lost a vertex are parted anew: edges of a block join two of its vertices, and no others do.
    """
    left, now = set(weight), blocks(near, set(weight))
    degree = {v: len(near[v]) for v in left}
    links, total = sum(degree.values()) / 2, sum(weight.values())
    strength = {v: (round(degree[v] / weight[v], 12), v) for v in left}
    gone, top, kept = [], links / total, 0
    while len(left) > len(query):
        weakest = {min(b - query, key=strength.__getitem__) for b in now if not b <= query}
        if not weakest:
            break
        if len(weakest) > 1 and all(degree[v] / weight[v] > alpha * links / total * (1 + TINY) for v in weakest):
            weakest = {min(weakest, key=strength.__getitem__)}
        for v in sorted(weakest):
            left.remove(v)
            gone.append(v)
            links, total = links - degree[v], total - weight[v]
            for w in near[v] & left:
                degree[w] -= 1
                strength[w] = (round(degree[w] / weight[w], 12), w)
        now = [part for b in now for part in ([b] if b.isdisjoint(weakest) else blocks(near, b - weakest))]
        if links / total > top * (1 + TINY):
            top, kept = links / total, len(gone)
    return set(weight).difference(gone[:kept])


def _tasks(links: DataFrame, nodes: DataFrame, asked: DataFrame, alpha: float) -> DataFrame:
    """``g, node``: ``peel`` of each group in a task of its own."""
    rows = links.select("g", "u", "v", F.lit(0.0).alias("x")).unionByName(nodes.select("g", F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), F.col("weight").alias("x")))
    rows = rows.unionByName(asked.select("g", F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(-1.0).alias("x")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ends, single = pdf[pdf.v.notna()], pdf[pdf.v.isna()]
        weight = dict(zip(single.u[single.x > 0], single.x[single.x > 0]))
        near: dict[int, set] = {v: set() for v in weight}
        for a, b in zip(ends.u, ends.v.astype("int64")):
            near[a].add(b)
            near[b].add(a)
        return pd.DataFrame({"g": pdf.g.iloc[0], "node": sorted(peel(near, weight, set(single.u[single.x < 0]), alpha))})

    # A small table would be one task otherwise, though each of its groups may take seconds.
    return rows.repartition(parallelism(rows.sparkSession), "g").groupBy("g").applyInPandas(run, "g long, node long")


def _thinned(links: DataFrame, nodes: DataFrame, asked: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round for groups too large for a task: all vertices at most ``alpha`` times the density go at once, but for the query. What is left, and ``g`` of groups that lost something."""
    degree = links.select("g", F.explode(F.array("u", "v")).alias("node")).groupBy("g", "node").agg(F.count(F.lit(1)).alias("d"))
    weak = F.coalesce("d", F.lit(0)) <= alpha * F.col("rho") * F.col("weight") * (1 + TINY)
    judged = nodes.join(degree, ["g", "node"], "left").join(density(links.withColumn("w", F.lit(1.0)), nodes), "g").join(asked.withColumn("asked", F.lit(True)), ["g", "node"], "left")
    judged = stored(judged.withColumn("goes", weak & F.col("asked").isNull()), "judged")
    stay = judged.filter("not goes").select("g", "node", "weight")
    one, two = stay.select("g", F.col("node").alias("u")), stay.select("g", F.col("node").alias("v"))
    inner = links.join(one, ["g", "u"], "left_semi").join(two, ["g", "v"], "left_semi").select("g", "u", "v")
    return stored(inner, "thin_links"), stored(stay, "thin"), stored(judged.filter("goes").select("g").distinct(), "moved")


def greedy(links: DataFrame, weights: DataFrame, queries: DataFrame, alpha: float = 2.0, small: int = SMALL) -> DataFrame:
    """``query_id, node``: of the part of ``links`` (query_id, u, v) that holds the whole query, the densest state met by peeling (edges over summed ``weight``), and the query.

    Queries of up to ``small`` links are peeled block by block, one task each. Larger ones first lose all weak vertices of a round at once, by joins: a mean vertex has twice the density, so
    such rounds are few; blocks are then peeled in what is left, and the denser of the states met by both is the answer. A query whose vertices no part holds is its own answer.
    """
    asked = stored(queries.select(F.col("query_id").alias("g"), "node").distinct(), "asked")
    nodes = weights.select(F.col("query_id").alias("g"), "node", "weight")
    label = components(links, weights.select("query_id", "node"), by=["query_id"]).withColumnRenamed("query_id", "g")
    need = asked.groupBy("g").agg(F.count(F.lit(1)).alias("need"))
    hit = asked.join(label, ["g", "node"]).groupBy("g", "component").agg(F.count(F.lit(1)).alias("has")).join(need, "g").filter("has = need")
    inside = label.join(hit.select("g", "component"), ["g", "component"]).select("g", "node")
    nodes = stored(nodes.join(inside, ["g", "node"]), "whole")
    renamed = links.withColumnRenamed("query_id", "g")
    links = stored(renamed.join(inside.withColumnRenamed("node", "u"), ["g", "u"], "left_semi").select("g", "u", "v"), "whole_links")
    states, step = [], 0
    large = stored(links.groupBy("g").count().filter(F.col("count") > small).select("g"), "large")
    ready_nodes, ready_links = nodes.join(large, "g", "left_anti"), links.join(large, "g", "left_anti")
    nodes, links = nodes.join(large, "g", "left_semi"), links.join(large, "g", "left_semi")
    while not large.isEmpty():
        states.append((step, nodes.select("g", "node", "weight"), links))
        links, nodes, moved = _thinned(links, nodes, asked, alpha)
        size = links.groupBy("g").count()
        still = stored(moved.join(size, "g").filter(F.col("count") > small).select("g"), "large")
        ready_nodes, ready_links = ready_nodes.unionByName(nodes.join(still, "g", "left_anti")), ready_links.unionByName(links.join(still, "g", "left_anti"))
        nodes, links, step = nodes.join(still, "g", "left_semi"), links.join(still, "g", "left_semi"), step + 1
        large = still
    final = stored(_tasks(ready_links, ready_nodes, asked.join(ready_nodes.select("g").distinct(), "g", "left_semi"), alpha), "peeled")
    if states:
        best = final.join(ready_nodes, ["g", "node"])
        rho = density(ready_links.join(final.withColumnRenamed("node", "u"), ["g", "u"], "left_semi").join(final.withColumnRenamed("node", "v"), ["g", "v"], "left_semi").withColumn("w", F.lit(1.0)), best)
        every = rho.select("g", F.lit(len(states)).alias("step"), "rho")
        members = final.select("g", "node", F.lit(len(states)).alias("step"))
        for i, n, e in states:
            every = every.unionByName(density(e.withColumn("w", F.lit(1.0)), n).select("g", F.lit(i).alias("step"), "rho"))
            members = members.unionByName(n.select("g", "node", F.lit(i).alias("step")))
        top = every.groupBy("g").agg(F.min_by("step", F.struct((-F.round("rho", 12)).alias("r"), "step")).alias("step"))
        final = members.join(top, ["g", "step"]).select("g", "node")
    return final.unionByName(asked).distinct().select(F.col("g").alias("query_id"), "node")
