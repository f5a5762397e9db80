"""Searches by cores, trusses, cliques and edge connectivity: components of filtered graphs, shared by all queries of one level."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...plans.iterate import discard, stored
from ..blocks import levels, spanning
from ..connectivity import edge_connectivity
from ..structure import clique_overlaps, cliques, components, core_numbers, triangles, truss_numbers

#: Links of a forest that one task takes.
SMALL = 1_000_000


def _covering(queries: DataFrame, labelled: DataFrame, by: list[str]) -> DataFrame:
    """``query_id, *by, component`` of the components that hold all vertices of a query."""
    need = queries.groupBy("query_id").agg(F.count_distinct("node").alias("need"))
    hit = queries.select("query_id", "node").distinct().join(labelled, "node").groupBy("query_id", *by, "component").agg(F.count_distinct("node").alias("has"))
    return hit.join(need, "query_id").filter("has = need").select("query_id", *by, "component")


def kcore(edges: DataFrame, queries: DataFrame, cores: DataFrame | None = None, use_max: bool = False, small: int = SMALL) -> DataFrame:
    """The connected part with core numbers of k or more that holds the whole query; k is the least (or largest) core of the query.

    Edges first go down to a forest that joins the same at every level. If it has ``small`` links at most, one task labels all levels. Else they go from the
    highest down: what a level joins stays joined below, so each level only looks at its own links, between the parts of the level above.
    """
    cores = stored(core_numbers(edges), "cores") if cores is None else cores
    level = queries.join(cores, "node").groupBy("query_id").agg((F.max if use_max else F.min)("core").alias("k"), F.count(F.lit(1)).alias("known"))
    level = stored(level, "levels")
    ks = sorted((r.k for r in level.select("k").distinct().collect()), reverse=True)  # levels: at most the largest core
    need = queries.groupBy("query_id").agg(F.count_distinct("node").alias("need"))
    asked = stored(queries.select("query_id", "node").join(level, "query_id").join(need, "query_id").select("query_id", "node", "k", "need"), "asked")
    if not ks:
        return queries.select("query_id", "node").limit(0)
    cu, cv = cores.select(F.col("node").alias("u"), F.col("core").alias("cu")), cores.select(F.col("node").alias("v"), F.col("core").alias("cv"))
    top = F.element_at(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k <= F.least("cu", "cv")), 1)
    weighted = edges.join(cu.hint("merge"), "u").join(cv.hint("merge"), "v").filter(F.least("cu", "cv") >= ks[-1]).select("u", "v", top.alias("k"))
    weighted = forest(stored(weighted, "weighted"), small)
    if (n := weighted.count()) > small:  # only the parts that hold a vertex of a query at the lowest level can answer
        whole = stored(components(weighted), "whole")
        held = stored(whole.join(asked.select("node").distinct(), "node", "left_semi").select("component").distinct(), "held")
        near = stored(weighted.join(whole.join(held, "component", "left_semi").select(F.col("node").alias("u")), "u", "left_semi"), "near")
        for old in (weighted, whole):
            discard(old)
        weighted, n = near, near.count()
    if n <= small:
        labels = weighted.repartition(1).mapInPandas(partial(levels, ks=ks), f"k {weighted.schema['k'].dataType.simpleString()}, node long, component long")
        return stored(_answers(asked, stored(labels, "labels"), ["k"], use_max), "found")
    labels, out = None, None
    for k in ks:
        links = weighted.filter(F.col("k") == k).select("u", "v")
        if labels is None:
            labels = stored(components(links), "labels")
        else:
            a, b = labels.select(F.col("node").alias("u"), F.col("component").alias("a")), labels.select(F.col("node").alias("v"), F.col("component").alias("b"))
            apart = links.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")).filter("u <> v")
            joined = stored(components(apart), "joined")
            here = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
            after = stored(here.unionByName(joined.join(labels, "node", "left_anti")), "labels")
            discard(labels)
            discard(joined)
            labels = after
        got = stored(_answers(asked.filter(F.col("k") == k).drop("k"), labels, [], use_max), "found")
        out = got if out is None else out.unionByName(got)
    return out


def forest(links: DataFrame, rows: int = SMALL) -> DataFrame:
    """Of ``links`` (u, v, k) a part that joins at every level of k and higher what they join: spanning forests of the largest k, each of ranges of u with
    about ``rows`` links, again while that halves them. Stored; ``links``, stored as well, goes."""
    before, kind = links.count(), "u {}, v {}, k {}".format(*(links.schema[c].dataType.simpleString() for c in "uvk"))
    while True:
        less = stored(links.select("u", "v", "k").repartitionByRange(max(1, -(-before // rows)), "u").mapInPandas(spanning, kind), "forest")
        discard(links)
        links, after = less, less.count()
        if 2 * after > before or before <= rows:
            return links
        before = after


def _answers(asked: DataFrame, labels: DataFrame, by: list[str], use_max: bool) -> DataFrame:
    """``query_id, node`` of the component that holds all vertices of a query (``asked``: query_id, node, need), or with ``use_max`` the first that holds one."""
    hit = asked.join(labels, [*by, "node"]).groupBy("query_id", *by, "component").agg(F.count_distinct("node").alias("has"), F.first("need").alias("need"))
    first = Window.partitionBy("query_id").orderBy("component")
    hit = hit.filter("has = need" if not use_max else "has > 0").withColumn("r", F.row_number().over(first)).filter("r = 1")
    return hit.select("query_id", *by, "component").join(labels, [*by, "component"]).select("query_id", "node")


def ktruss(edges: DataFrame, queries: DataFrame, k: int = 4, trusses: DataFrame | None = None) -> DataFrame:
    """All k-truss communities that touch the first query vertex: edges of truss k or more, linked through triangles of such edges. k below 3 counts as 3."""
    k = max(3, k)
    trusses = truss_numbers(edges) if trusses is None else trusses
    strong = stored(trusses.filter(F.col("truss") >= k).select("u", "v"), "strong")
    ids = strong.withColumn("e", F.struct("u", "v"))
    tri = triangles(strong)
    e = lambda p, q: F.struct(F.col(p).alias("u"), F.col(q).alias("v"))
    links = tri.select(F.explode(F.array(F.struct(e("x", "y").alias("u"), e("x", "z").alias("v")), F.struct(e("x", "y").alias("u"), e("y", "z").alias("v")))).alias("l")).select("l.u", "l.v")
    labels = components(links, ids.select(F.col("e").alias("node"))).withColumnRenamed("node", "e")
    member = stored(ids.join(labels, "e").select("component", F.explode(F.array("u", "v")).alias("node")).distinct(), "truss")
    first = queries.groupBy("query_id").agg(F.min_by("node", "pos") if "pos" in queries.columns else F.min("node")).toDF("query_id", "node")
    return first.join(member, "node").select("query_id", "component").join(member, "component").select("query_id", "node").distinct()


def percolation(edges: DataFrame, k: int, found: DataFrame | None = None) -> DataFrame:
    """``component, first, node`` of the clique communities at k: maximal cliques of k vertices or more, linked where they share k - 1. ``first``: the least clique."""
    k = max(2, k)
    found = stored(cliques(edges), "cliques") if found is None else found
    large = found.filter(F.size("clique") >= k)
    keyed = stored(large.select("clique"), "cliques")
    shared = clique_overlaps(keyed).filter(F.col("overlap") >= k - 1)
    labels = components(shared.select(F.col("a").alias("u"), F.col("b").alias("v")), keyed.select(F.col("clique").alias("node")))
    named = stored(labels.select("component", F.col("node").alias("clique")), "named")
    first = named.groupBy("component").agg(F.min("clique").alias("first"))
    return named.select("component", F.explode("clique").alias("node")).distinct().join(first, "component").select("component", "first", "node")


def kclique(edges: DataFrame, queries: DataFrame, k: int = 3, found: DataFrame | None = None) -> DataFrame:
    """The clique community at k that holds the query: of several, the one with most vertices, then with the smallest vertex, then with the least clique."""
    member = stored(percolation(edges, k, found), "percolation")
    size = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.min("first").alias("first"))
    cover = _covering(queries, member.select("component", "node"), []).join(size, "component")
    pick = cover.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "least", "first"))).filter("r = 1")
    return pick.select("query_id", "component").join(member, "component").select("query_id", "node")


def kclique_densest(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """The community at the largest k that still holds the query; the loosest level (k = 2) never answers."""
    found = stored(cliques(edges), "cliques")
    top = found.agg(F.max(F.size("clique"))).first()[0] or 2
    left, out = queries, None
    for k in range(top, 2, -1):
        got = stored(kclique(edges, left, k, found), "densest")
        out = got if out is None else out.unionByName(got)
        left = stored(left.join(got.select("query_id").distinct(), "query_id", "left_anti"), "left")
        if left.isEmpty():
            break
    return out if out is not None else queries.select("query_id", "node").limit(0)


def kecc(edges: DataFrame, queries: DataFrame, weighted: DataFrame | None = None) -> DataFrame:
    """The part with the largest edge connectivity that holds the whole query: components of all levels of ``weighted`` in one pass."""
    weighted = stored(edge_connectivity(edges), "ecc") if weighted is None else weighted
    levels = weighted.select(F.col("w").alias("k")).distinct()
    layered = weighted.join(F.broadcast(levels), F.col("w") >= F.col("k")).select("k", "u", "v")  # levels: at most the largest connectivity
    labels = stored(components(layered, by=["k"]), "levels")
    cover = _covering(queries, labels, ["k"])
    best = cover.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("k")))).filter("r = 1")
    return best.select("query_id", "k", "component").join(labels, ["k", "component"]).select("query_id", "node")
