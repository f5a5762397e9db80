"""Searches by query-biased density, edges over summed weights 1 / proximity, as joins over all queries at once; and trees that join the vertices of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.iterate import discard, stored
from ..densest import SMALL, densest
from ..structure import adjacency, components, proximity_each, spanning_forest
from .local import query_biased_density
from .peeling import SMALL as PEELED
from .peeling import greedy

#: Stands for all vertices that a query has merged; ids of the graph are 0 or more.
MERGED = -1
#: Least proximity that counts, so largest weight.
LEAST = 1e-8


def biased_weights(edges: DataFrame, queries: DataFrame, c: float = 0.85, rounds: int = 10) -> DataFrame:
    """``query_id, node, weight``: 1 / proximity of the vertices within ``rounds`` steps of a query. All others would weigh 1 / ``LEAST`` and join no dense part."""
    near = proximity_each(edges, queries, c, rounds)
    return stored(near.select("query_id", "node", (1.0 / F.greatest(F.col("rank"), F.lit(LEAST))).alias("weight")), "weights")


def _links(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """``query_id, u, v``: the edges among each query's weighted vertices."""
    one, two = weights.select("query_id", F.col("node").alias("u")), weights.select("query_id", F.col("node").alias("v"))
    return stored(edges.join(one, "u").join(two, ["query_id", "v"]).select("query_id", "u", "v"), "near_links")


def densest_biased(edges: DataFrame, queries: DataFrame, c: float = 0.85, rounds: int = 10, small: int = SMALL) -> DataFrame:
    """The largest vertex set of the largest query-biased density, exactly, and the query itself. The set need not hold the query, nor be connected."""
    weights = biased_weights(edges, queries, c, rounds)
    links = _links(edges, weights)
    found = densest(links.select(F.col("query_id").alias("g"), "u", "v", F.lit(1.0).alias("w")), weights.withColumnRenamed("query_id", "g"), small)
    return found.select(F.col("g").alias("query_id"), "node").unionByName(queries.select("query_id", "node")).distinct()


def contracted_density(edges: DataFrame, queries: DataFrame, c: float = 0.85, rounds: int = 10, small: int = SMALL) -> DataFrame:
    """The query merged into one vertex; while the densest set doesn't hold that vertex, it is merged too; then the densest set is the answer.

    The merged vertex weighs what its members weigh together, and edges inside it no longer count. A query whose densest set is empty keeps what it has merged.
    All queries go through the rounds together, each until it is answered.
    """
    weights = biased_weights(edges, queries, c, rounds)
    links = _links(edges, weights)
    merged = stored(queries.select("query_id", "node").distinct(), "merged")
    todo, answers = stored(merged.select("query_id").distinct(), "todo"), []
    while not todo.isEmpty():
        now = merged.join(todo, "query_id", "left_semi").withColumn("in", F.lit(MERGED).cast("long"))
        u, v = now.select("query_id", F.col("node").alias("u"), F.col("in").alias("iu")), now.select("query_id", F.col("node").alias("v"), F.col("in").alias("iv"))
        moved = links.join(todo, "query_id", "left_semi").join(u, ["query_id", "u"], "left").join(v, ["query_id", "v"], "left").select("query_id", F.coalesce("iu", "u").alias("u"), F.coalesce("iv", "v").alias("v"))
        joined = moved.filter("u <> v").groupBy(F.col("query_id").alias("g"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w"))
        each = weights.join(todo, "query_id", "left_semi").join(now, ["query_id", "node"], "left").groupBy(F.col("query_id").alias("g"), F.coalesce("in", "node").alias("node")).agg(F.sum("weight").alias("weight"))
        found = stored(densest(joined, each, small).withColumnRenamed("g", "query_id"), "densest")
        holds = found.filter(F.col("node") == MERGED).select("query_id")
        fresh = stored(found.filter(F.col("node") != MERGED), "fresh")
        grown = stored(merged.unionByName(fresh).distinct(), "merged")
        done = stored(todo.join(holds, "query_id", "left_semi").unionByName(todo.join(fresh.select("query_id"), "query_id", "left_anti")).distinct(), "done")
        answers.append(stored(grown.join(done, "query_id", "left_semi"), "answer"))
        rest = stored(todo.join(done, "query_id", "left_anti"), "todo")
        for old in (merged, todo, found):
            discard(old)
        merged, todo = grown, rest
    out = queries.select("query_id", "node")
    for a in answers:
        out = out.unionByName(a)
    return out.distinct()


def block_peeled(edges: DataFrame, queries: DataFrame, alpha: float = 2.0, c: float = 0.85, rounds: int = 10, small: int = PEELED) -> DataFrame:
    """``greedy`` peeling, block by block, of the vertices within ``rounds`` steps of a query. A query that no part of the graph joins is its own answer."""
    weights = biased_weights(edges, queries, c, rounds)
    return greedy(_links(edges, weights), weights, queries, alpha, small)


def _denser(edges: DataFrame, weights: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """``query_id, node``: of two answers to each query that with more edges for its summed weights, the first of equals. Vertices without a weight weigh 1 / ``LEAST``."""
    both = stored(one.select("query_id", "node", F.lit(0).alias("way")).unionByName(two.select("query_id", "node", F.lit(1).alias("way"))), "ways")
    a, b = both.select("query_id", "way", F.col("node").alias("u")), both.select("query_id", "way", F.col("node").alias("v"))
    inner = edges.join(a, "u").join(b, ["query_id", "way", "v"]).groupBy("query_id", "way").agg(F.count(F.lit(1)).alias("e"))
    total = both.join(weights, ["query_id", "node"], "left").groupBy("query_id", "way").agg(F.sum(F.coalesce("weight", F.lit(1 / LEAST))).alias("w"))
    value = F.round(F.coalesce("e", F.lit(0)) / F.col("w"), 12)
    best = total.join(inner, ["query_id", "way"], "left").groupBy("query_id").agg(F.min_by("way", F.struct((-value).alias("d"), "way")).alias("way"))
    return both.join(best, ["query_id", "way"]).select("query_id", "node")


def best_biased(edges: DataFrame, queries: DataFrame, k: float = 20, c: float = 0.85, rounds: int = 10, small: int = SMALL, alpha: float = 2.0) -> DataFrame:
    """``contracted_density``; where that isn't connected, its component that holds the whole query and more; where there is none, the denser of ``block_peeled`` and ``query_biased_density``."""
    whole = stored(contracted_density(edges, queries, c, rounds, small), "contracted")
    inner = edges.join(whole.select("query_id", F.col("node").alias("u")), "u").join(whole.select("query_id", F.col("node").alias("v")), ["query_id", "v"]).select("query_id", "u", "v")
    label = stored(components(inner, whole, by=["query_id"]), "parts")
    asked = queries.select("query_id", "node").distinct().withColumn("asked", F.lit(1))
    held = label.join(asked, ["query_id", "node"], "left").groupBy("query_id", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("asked", F.lit(0))).alias("has"))
    need = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    parts = held.groupBy("query_id").agg(F.count(F.lit(1)).alias("parts"))
    good = stored(held.join(need, "query_id").join(parts, "query_id").filter("has = need and (n > need or parts = 1)").select("query_id", "component"), "good")
    first = label.join(good, ["query_id", "component"]).select("query_id", "node")
    left = stored(queries.join(good, "query_id", "left_anti").select("query_id", "node"), "left")
    if left.isEmpty():
        return first
    weights = biased_weights(edges, left, c, rounds)
    peeled = greedy(_links(edges, weights), weights, left, alpha)
    return first.unionByName(_denser(edges, weights, peeled, query_biased_density(edges, left, k, c, rounds)))


def regions(edges: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``query_id, node, dist, region, parent`` of the vertices around each query's vertices, the nearest of which names the ``region``; and ``query_id, a, b, length, u, v``,
    the shortest link (least ends) between two regions.

    Each query's regions grow step by step until links join all of them (or nothing is left to reach); shorter links than those between reached vertices can't come later.
    """
    adj = stored(adjacency(edges), "adj")
    seen = front = stored(queries.select("query_id", "node").distinct().select("query_id", "node", F.lit(0).alias("dist"), F.col("node").alias("region"), F.lit(None).cast("long").alias("parent")), "seen")
    dist = 0
    while True:
        u = seen.select("query_id", F.col("node").alias("u"), F.col("dist").alias("du"), F.col("region").alias("ru"))
        v = seen.select("query_id", F.col("node").alias("v"), F.col("dist").alias("dv"), F.col("region").alias("rv"))
        border = edges.join(u, "u").join(v, ["query_id", "v"]).filter("ru <> rv").select("query_id", F.least("ru", "rv").alias("a"), F.greatest("ru", "rv").alias("b"), F.struct((F.col("du") + F.col("dv") + 1).alias("length"), "u", "v").alias("l"))
        border = stored(border.groupBy("query_id", "a", "b").agg(F.min("l").alias("l")).select("query_id", "a", "b", "l.*"), "border")
        homes = queries.select("query_id", "node").distinct()
        apart = components(border.select("query_id", F.col("a").alias("u"), F.col("b").alias("v")), homes, by=["query_id"]).groupBy("query_id").agg(F.count_distinct("component").alias("n")).filter("n > 1").select("query_id")
        step = front.join(apart, "query_id", "left_semi").select("query_id", F.col("node").alias("s"), "region").join(adj, "s").groupBy("query_id", F.col("d").alias("node")).agg(F.min(F.struct("region", "s")).alias("m"))
        dist += 1
        front = stored(step.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").select("query_id", "node", F.lit(dist).alias("dist"), F.col("m.region").alias("region"), F.col("m.s").alias("parent")), "front")
        if front.isEmpty():
            return seen, border
        seen = stored(seen.unionByName(front), "seen")
        discard(border)


def joined(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, node``: the query's vertices joined by a tree of at most twice the edges of the smallest such tree; vertices that nothing joins stay apart.

    A spanning tree of the regions by their shortest links, whose ends then climb to their region's own vertex (Mehlhorn). Ties go to the least ids.
    """
    seen, border = regions(edges, queries)
    tree = spanning_forest(border.select("query_id", F.col("a").alias("u"), F.col("b").alias("v"), (-F.col("length")).alias("w")), by=["query_id"]).select("query_id", F.col("u").alias("a"), F.col("v").alias("b"))
    front = stored(border.join(tree, ["query_id", "a", "b"]).select("query_id", F.explode(F.array("u", "v")).alias("node")).distinct(), "climbing")
    out = queries.select("query_id", "node")
    while not front.isEmpty():
        out = out.unionByName(front)
        front = stored(front.join(seen.filter("parent is not null").select("query_id", "node", "parent"), ["query_id", "node"]).select("query_id", F.col("parent").alias("node")).distinct(), "climbing")
    return out.distinct()
