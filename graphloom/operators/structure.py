"""Structure of a graph: degrees, triangles, cores, trusses, components, distances, cliques, spanning forests, diffusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio, scaled as scaled_column
from ..plans.iterate import dealt, discard, few, fixpoint, stored
from .blocks import FREE, TRIPLES, halves, settled_edges, settled_vertices, tile


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("s"), F.col("v").alias("d")).unionByName(edges.select(F.col("v").alias("s"), F.col("u").alias("d")))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v")


def add_edges(edges: DataFrame, delta: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(delta.select("u", "v"))
    return dealt(both, both.count(), "u", "v").distinct()


def remove_edges(edges: DataFrame, delta: DataFrame) -> DataFrame:
    return edges.join(delta.select("u", "v"), ["u", "v"], "left_anti")


def two_hop(edges: DataFrame) -> DataFrame:
    """``s, d``: different vertices with a common neighbour."""
    adj = adjacency(edges)
    return adj.select("s", F.col("d").alias("m")).join(adj.select(F.col("s").alias("m"), "d"), "m").filter("s <> d").select("s", "d").distinct()


#: Normalisations of the adjacency A with degrees D: ``loops`` adds the identity to A first, ``diagonal`` what is added after, ``sign`` of the rest.
ADJACENCY_KINDS = {
    "none": {"by": "one"},
    "self": {"by": "one", "loops": True},
    "sym": {"by": "both"},
    "aug": {"by": "both", "loops": True},
    "row": {"by": "row"},
    "aug_row": {"by": "row", "loops": True},
    "first_order": {"by": "both", "diagonal": "one"},
    "aug_plus": {"by": "both", "loops": True, "diagonal": "one"},
    "lap": {"by": "both", "diagonal": "one", "sign": -1},
    "row_lap": {"by": "row", "diagonal": "one", "sign": -1},
    "laplacian": {"by": "one", "diagonal": "degree", "sign": -1},
}


def normalised_adjacency(edges: DataFrame, kind: str = "sym") -> DataFrame:
    """``s, d, w``, one row for each nonzero place, by the kind's entry in ``ADJACENCY_KINDS``: ``both`` 1/sqrt(d_s d_d), ``row`` 1/d_s, ``one`` 1."""
    if kind not in ADJACENCY_KINDS:
        raise ValueError(f"unknown kind {kind}")
    how = ADJACENCY_KINDS[kind]
    deg, adj = degrees(edges), adjacency(edges)
    loop = deg.select(F.col("node").alias("s"), F.col("node").alias("d"))
    if how.get("loops"):
        adj = adj.unionByName(loop)
        deg = deg.withColumn("degree", F.col("degree") + 1)
    both = adj.join(deg.select(F.col("node").alias("s"), F.col("degree").alias("ds")), "s").join(deg.select(F.col("node").alias("d"), F.col("degree").alias("dd")), "d")
    w = {"one": F.lit(1.0), "row": 1.0 / F.col("ds"), "both": 1.0 / F.sqrt(F.col("ds") * F.col("dd").cast("double"))}[how["by"]]
    w = how.get("sign", 1) * w
    if how.get("loops") and how.get("diagonal"):
        return both.select("s", "d", (w + F.when(F.col("s") == F.col("d"), 1.0).otherwise(0.0)).alias("w"))
    out = both.select("s", "d", w.alias("w"))
    if how.get("diagonal"):
        value = F.lit(1.0) if how["diagonal"] == "one" else F.col("degree").cast("double")
        out = out.unionByName(deg.select(F.col("node").alias("s"), F.col("node").alias("d"), value.alias("w")))
    return out


def oriented(edges: DataFrame) -> DataFrame:
    """``a, b``: each edge from its end of smaller (degree, id) to the other, so that no vertex has many out-edges."""
    deg = degrees(edges)
    both = edges.join(deg.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(deg.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    return both.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"))


def triangles(edges: DataFrame) -> DataFrame:
    """``x, y, z`` with x < y < z, each triangle once."""
    out = oriented(edges)
    wedge = out.select("a", "b").join(out.select("a", F.col("b").alias("c")), "a").filter("b < c")
    closed = wedge.join(edges.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"])
    ends = F.array_sort(F.array("a", "b", "c"))
    return closed.select(ends[0].alias("x"), ends[1].alias("y"), ends[2].alias("z"))


def edge_support(edges: DataFrame) -> DataFrame:
    """``u, v, support``: triangles of each edge, 0 included."""
    t = triangles(edges)
    sides = t.select(F.explode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("x", "y"), ("x", "z"), ("y", "z"))])).alias("e")).select("e.u", "e.v")
    counted = sides.groupBy("u", "v").agg(F.count(F.lit(1)).alias("support"))
    return edges.join(counted, ["u", "v"], "left").select("u", "v", F.coalesce("support", F.lit(0)).alias("support"))


def clustering(edges: DataFrame) -> DataFrame:
    """``node, degree, triangles, cc``: cc = 2 T / (d (d - 1)), 0 below degree 2."""
    per = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    out = degrees(edges).join(per, "node", "left").withColumn("triangles", F.coalesce("t", F.lit(0)))
    return out.select("node", "degree", "triangles", ratio(2.0 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)).alias("cc"))


def degree_profile(edges: DataFrame, scaled: bool = False) -> DataFrame:
    """Degree, and least, largest, mean and deviation of the neighbours' degrees; z-scores over all vertices if ``scaled``."""
    deg = degrees(edges)
    out = adjacency(edges).join(deg.select(F.col("node").alias("d"), F.col("degree").alias("dd")), "d").groupBy(F.col("s").alias("node"))
    n, one, two = F.count(F.lit(1)).cast("decimal(12,0)"), F.sum("dd").cast("decimal(18,0)"), F.sum((F.col("dd") * F.col("dd")).cast("decimal(25,0)")).cast("decimal(25,0)")
    spread = F.sqrt((n * two - one * one).cast("double")) / F.count(F.lit(1))  # of whole numbers, so in whatever order the rows come
    out = out.agg(F.count(F.lit(1)).alias("degree"), F.min("dd").alias("nbr_min"), F.max("dd").alias("nbr_max"), F.avg("dd").alias("nbr_mean"), spread.alias("nbr_std"))
    names = ["degree", "nbr_min", "nbr_max", "nbr_mean", "nbr_std"]
    if scaled:
        out = scaled_column(stored(out, "profile"), names, "z_score")
    return out.select("node", *names)


def h_index(adj: DataFrame, values: DataFrame) -> DataFrame:
    """``node, value``: the largest h such that h neighbours have values of h or more.

    Neighbours are counted by value before they meet (partial sums), so a hub is a few rows, one for each different value.
    """
    counts = adj.join(values.select(F.col("node").alias("d"), "value"), "d").groupBy(F.col("s").alias("node"), "value").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("value")))
    return counts.withColumn("h", F.least("value", above)).groupBy("node").agg(F.max("h").alias("value"))


def h_index_orders(edges: DataFrame, orders: int = 3) -> DataFrame:
    """``node, h0 .. h<orders>``: degree, and the h-index applied again and again."""
    adj, values = stored(adjacency(edges)), degrees(edges).withColumnRenamed("degree", "value")
    out = values.withColumnRenamed("value", "h0")
    for i in range(1, orders + 1):
        values = stored(h_index(adj, values))
        out = out.join(values.withColumnRenamed("value", f"h{i}"), "node")
    return out


def h_index_vectors(edges: DataFrame) -> DataFrame:
    """``node, h, share``: of a vertex and its neighbours, the share with each h-index of degrees."""
    adj = stored(adjacency(edges), "adj")
    values = stored(h_index(adj, degrees(edges).withColumnRenamed("degree", "value")), "hindex")
    near = adj.select(F.col("s").alias("node"), "d").unionByName(values.select("node", F.col("node").alias("d")))
    counts = near.join(values.select(F.col("node").alias("d"), F.col("value").alias("h")), "d").groupBy("node", "h").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("node", "h", (F.col("n") / F.sum("n").over(Window.partitionBy("node"))).alias("share"))


def core_numbers(edges: DataFrame, vertices: DataFrame | None = None, half: int | None = None) -> DataFrame:
    """``node, core``, by h-indices to the fixpoint; with ``vertices`` (node), isolated ones have core 0.

    Blocks are ranges of ids with a bounded number of edges. One task settles a block, with the values of neighbours outside as bounds; then blocks
    shift by half, and those with a vertex whose neighbour outside has fallen are settled again, until none is left. Values only fall, and never below the cores.
    """
    adj = adjacency(edges)
    adj = stored(halves(adj, 2 * edges.count(), "s", half), "adj")
    state = stored(adj.groupBy("h", "s").agg(F.count(F.lit(1)).cast("int").alias("value")).select("h", F.col("s").alias("node"), "value"), "cores")
    bounds = stored(adj.groupBy("h").agg(F.min("s").alias("low"), F.max("s").alias("high")), "bounds")  # one row for each half
    active, turn = None, 0
    while True:
        tiles = bounds.groupBy(tile(F.col("h"), turn).alias("b")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        arcs = adj.withColumn("b", tile(F.col("h"), turn)).join(F.broadcast(tiles), "b")
        own = state.select(tile(F.col("h"), turn).alias("b"), F.col("node").alias("s"), "value")
        if active is not None:
            arcs, own = (x.join(F.broadcast(active), "b", "left_semi") for x in (arcs, own))  # blocks, not vertices
        inside = F.col("d").between(F.col("low"), F.col("high"))
        far = arcs.filter(~inside).select("b", "s", "d").join(state.select(F.col("node").alias("d"), F.col("value").alias("x")), "d")
        far = far.groupBy("b", "s", "x").agg(F.count(F.lit(1)).alias("n"))
        rows = own.select("b", F.lit(0).alias("kind"), "s", F.lit(0).cast("long").alias("o"), F.col("value").alias("x"))
        rows = rows.unionByName(arcs.filter(inside & (F.col("s") < F.col("d"))).select("b", F.lit(1).alias("kind"), "s", F.col("d").alias("o"), F.lit(FREE).alias("x")))
        rows = rows.unionByName(far.select("b", F.lit(2).alias("kind"), "s", F.col("n").alias("o"), "x"))
        tasks = tiles.count() if active is None else active.count()
        fresh = stored(rows.repartition(max(1, tasks), "b").groupBy("b").applyInPandas(settled_vertices, "node long, value int"), "fresh")
        after = state.join(fresh.select("node", F.col("value").alias("new")), "node", "left")
        after = stored(after.select("h", "node", F.coalesce("new", "value").alias("value"), F.coalesce(F.col("new") < F.col("value"), F.lit(False)).alias("fell")), "cores")
        fallen = after.filter("fell").select(F.col("node").alias("d"))
        # Whoever has a neighbour outside its block that has fallen.
        far = adj.withColumn("b", tile(F.col("h"), turn)).join(F.broadcast(tiles), "b").filter(~inside).select("h", "d")
        turn += 1
        active = stored(far.join(fallen, "d", "left_semi").select(tile(F.col("h"), turn).alias("b")).distinct(), "active")
        for old in (state, fresh):
            discard(old)
        state = after.select("h", "node", "value")
        if active.isEmpty():
            break
    cores = state.select("node", F.col("value").cast("long").alias("core"))
    if vertices is not None:
        cores = vertices.select("node").distinct().join(cores, "node", "left").select("node", F.coalesce("core", F.lit(0)).alias("core"))
    return cores


def truss_numbers(edges: DataFrame, half: int = TRIPLES) -> DataFrame:
    """``u, v, truss``: 2 plus the fixpoint of h-indices over the triangles of each edge, with the lesser of the other two edges as value.

    As cores by blocks: an edge is in the block of its lesser end, and a triangle goes to the one or two blocks that its edges are in, so no round
    moves rows for single edges of triangles within a block.
    """
    tri = stored(triangles(edges), "triangles")
    lesser = tri.select(F.explode(F.array("x", "y")).alias("node"))
    place = stored(halves(lesser, 2 * tri.count(), "node", half).distinct(), "places")  # node, h
    hx, hy = place.select(F.col("node").alias("x"), F.col("h").alias("hx")), place.select(F.col("node").alias("y"), F.col("h").alias("hy"))
    placed = stored(tri.join(hx, "x").join(hy, "y").select("x", "y", "z", "hx", "hy"), "triangles")
    discard(tri)
    state, active, turn = None, None, 0
    while True:
        bx, by = tile(F.col("hx"), turn), tile(F.col("hy"), turn)
        whole = placed.filter(bx == by).select(bx.alias("b"), F.lit(0).alias("kind"), "x", "y", "z", F.lit(FREE).alias("least"))
        cross = placed.filter(bx != by).withColumns({"bx": bx, "by": by})
        if state is None:
            valued = cross.withColumns({c: F.lit(FREE) for c in ("xy", "xz", "yz")})
        else:
            valued = cross.join(F.broadcast(active), F.col("b").isin(F.col("bx"), F.col("by")), "left_semi")
            for p, q in (("x", "y"), ("x", "z"), ("y", "z")):
                valued = valued.join(state.select(F.col("u").alias(p), F.col("v").alias(q), F.col("value").alias(p + q)), [p, q])
        rows = whole.unionByName(valued.select(F.col("bx").alias("b"), F.lit(1).alias("kind"), "x", "y", "z", F.col("yz").alias("least")))
        rows = rows.unionByName(valued.select(F.col("by").alias("b"), F.lit(2).alias("kind"), "x", "y", "z", F.least("xy", "xz").alias("least")))
        if state is not None:
            rows = rows.unionByName(state.select(tile(F.col("h"), turn).alias("b"), F.lit(3).alias("kind"), F.col("u").alias("x"), F.col("v").alias("y"), F.col("v").alias("z"), F.col("value").alias("least")))
            rows = rows.join(F.broadcast(active), "b", "left_semi")  # blocks, not edges
        tasks = (placed.select(bx.alias("b")).distinct() if active is None else active).count()
        fresh = stored(rows.repartition(max(1, tasks), "b").groupBy("b").applyInPandas(settled_edges, "u long, v long, value int"), "fresh")
        if state is None:
            after = stored(fresh.join(place.withColumnRenamed("node", "u"), "u").select("h", "u", "v", "value", F.lit(True).alias("fell")), "trusses")
        else:
            after = state.join(fresh.withColumnRenamed("value", "new"), ["u", "v"], "left")
            after = stored(after.select("h", "u", "v", F.coalesce("new", "value").alias("value"), F.coalesce(F.col("new") < F.col("value"), F.lit(False)).alias("fell")), "trusses")
            discard(state)
        discard(fresh)
        state, turn = after.select("h", "u", "v", "value"), turn + 1
        # The other block of a triangle in two blocks one of whose edges has fallen.
        fallen = after.filter("fell").select("u", "v")
        there = (("x", "y", "hy"), ("x", "z", "hy"), ("y", "z", "hx"))
        hit = [cross.join(fallen.select(F.col("u").alias(p), F.col("v").alias(q)), [p, q], "left_semi").select(tile(F.col(h), turn).alias("b")) for p, q, h in there]
        active = stored(hit[0].unionByName(hit[1]).unionByName(hit[2]).distinct(), "active")
        if active.isEmpty():
            break
    return edges.join(state, ["u", "v"], "left").select("u", "v", (F.coalesce(F.col("value").cast("long"), F.lit(0)) + 2).alias("truss"))


def components(edges: DataFrame, vertices: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """``node, component`` (least id of the component), within each group of the columns ``by``.

    Each round a vertex moves to whichever of itself and its neighbours has the least hash of that round, links follow their
    ends and loops and repeats go. No two neighbours both stay, so a share of the vertices goes each round however long the chains are.
    """
    by = by or []
    links = stored(edges.filter("u <> v").select(*by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    nodes = links.select(*by, F.explode(F.array("u", "v")).alias("node"))
    if vertices is not None:
        nodes = nodes.unionByName(vertices.select(*by, "node"))
    labels, turn = stored(nodes.distinct().withColumn("root", F.col("node")), "labels"), 0
    while not links.isEmpty():
        rank = lambda c, r=turn: F.struct(F.xxhash64(F.lit(r), F.col(c)), F.col(c).alias("x"))
        both = links.select(*by, F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links.select(*by, F.col("v").alias("a"), F.col("u").alias("b")))
        to = stored(both.groupBy(*by, "a").agg(F.min(rank("b")).alias("m")).select(*by, "a", F.least(rank("a"), F.col("m"))["x"].alias("p")), "moves")
        moved = stored(labels.join(to.withColumnRenamed("a", "root"), [*by, "root"], "left").select(*by, "node", F.coalesce("p", "root").alias("root")), "labels")
        one, two = to.select(*by, F.col("a").alias("u"), F.col("p").alias("pu")), to.select(*by, F.col("a").alias("v"), F.col("p").alias("pv"))
        rest = links.join(one, [*by, "u"]).join(two, [*by, "v"]).filter("pu <> pv").select(*by, F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        rest = stored(rest, "links")
        for old in (links, labels, to):
            discard(old)
        links, labels, turn = rest, moved, turn + 1
    least = labels.groupBy(*by, "root").agg(F.min("node").alias("component"))
    return labels.join(least, [*by, "root"]).select(*by, "node", "component")


def bfs(edges: DataFrame, sources: DataFrame, limit: int | None = None, by: list[str] | None = None) -> DataFrame:
    """``node, dist`` (and ``parent``, the least neighbour one step nearer) from ``sources`` (node), for each group ``by``; ``limit`` steps at most."""
    by = by or []
    adj = stored(adjacency(edges), "adj")
    seen = stored(sources.select(*by, "node").distinct().withColumns({"dist": F.lit(0), "parent": F.lit(None).cast("long")}), "seen")
    front, dist = seen, 0
    while limit is None or dist < limit:
        dist += 1
        step = front.select(*by, F.col("node").alias("s")).join(adj, "s").groupBy(*by, F.col("d").alias("node")).agg(F.min("s").alias("parent"))
        front = stored(step.join(seen.select(*by, "node"), [*by, "node"], "left_anti").select(*by, "node", F.lit(dist).alias("dist"), "parent"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if dist % 8 == 0:
            seen = stored(seen, "seen")
    return seen


def biconnected(edges: DataFrame) -> DataFrame:
    """``u, v, block``: edges of one block lie on a common simple cycle; a block of one edge is a bridge. Loops and repeats of edges go.

    In a forest of breadth-first trees an edge outside it joins vertices neither of which lies below the other. Both ends climb, one join a level,
    until they meet; every vertex then learns the highest meeting point of such edges from below it, level by level upwards. A vertex
    shares its parent's block if such an edge reaches above the parent, or if an edge outside the forest joins both (Tarjan and Vishkin).
    """
    plain = stored(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "plain")
    tree = stored(bfs(plain, components(plain).select(F.col("component").alias("node")).distinct()), "tree")
    up = tree.select("node", F.col("dist").cast("long").alias("dist"), "parent")
    ends = plain.join(up.select(F.col("node").alias("u"), F.col("dist").alias("du"), F.col("parent").alias("pu")), "u").join(up.select(F.col("node").alias("v"), F.col("dist").alias("dv"), F.col("parent").alias("pv")), "v")
    ends = stored(ends.withColumn("inside", F.coalesce(F.col("pu") == F.col("v"), F.lit(False)) | F.coalesce(F.col("pv") == F.col("u"), F.lit(False))), "ends")
    outside = ends.filter("not inside")
    # The deeper end first climbs to the other's level: levels differ by one at most.
    one, two = F.when(F.col("du") > F.col("dv"), F.col("pu")).otherwise(F.col("u")), F.when(F.col("dv") > F.col("du"), F.col("pv")).otherwise(F.col("v"))
    climbing, met = stored(outside.select("u", "v", one.alias("x"), two.alias("y"), F.least("du", "dv").alias("level")), "climbing"), None
    while not climbing.isEmpty():
        here = climbing.filter("x = y").select("u", "v", "level")
        met = here if met is None else met.unionByName(here)
        rest = climbing.filter("x <> y")
        rest = rest.join(up.select(F.col("node").alias("x"), F.col("parent").alias("px")), "x").join(up.select(F.col("node").alias("y"), F.col("parent").alias("py")), "y")
        climbing = stored(rest.select("u", "v", F.col("px").alias("x"), F.col("py").alias("y"), (F.col("level") - 1).alias("level")), "climbing")
    links = outside.select("u", "v")
    if met is not None:
        least = met.select(F.explode(F.array("u", "v")).alias("node"), "level").groupBy("node").agg(F.min("level").alias("low"))
        own = stored(up.join(least, "node", "left"), "own")
        deepest = own.agg(F.max("dist")).first()[0]
        below, done = own.filter(F.col("dist") == deepest).select("node", "parent", "dist", "low"), []
        for level in range(deepest, 0, -1):
            below = stored(below, "below")
            done.append(below)
            reach = below.groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("from_below"))
            below = own.filter(F.col("dist") == level - 1).join(reach, "node", "left").select("node", "parent", "dist", F.least("low", "from_below").alias("low"))
        for rows in done:
            links = links.unionByName(rows.filter("low < dist - 1").select(F.col("node").alias("u"), F.col("parent").alias("v")))
    block = components(links, up.filter("parent is not null").select("node")).withColumnRenamed("component", "block")
    lower = F.when(F.coalesce(F.col("pu") == F.col("v"), F.lit(False)), F.col("u")).when(F.coalesce(F.col("pv") == F.col("u"), F.lit(False)), F.col("v")).otherwise(F.col("u"))
    return ends.withColumn("node", lower).join(block, "node").select("u", "v", "block")


def articulation_points(edges: DataFrame) -> DataFrame:
    """``node``: vertices in more than one block, whose removal disconnects their neighbours."""
    ends = biconnected(edges).select(F.explode(F.array("u", "v")).alias("node"), "block").distinct()
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")


def shortest_path(edges: DataFrame, source: int, target: int) -> DataFrame:
    """``pos, node`` along the shortest path that takes the least parent at each step; empty if there is none."""
    spark = edges.sparkSession
    reached = stored(bfs(edges, spark.createDataFrame([(source,)], "node long")), "reached")
    at = reached.filter(F.col("node") == target).first()
    path = []
    while at is not None:
        path.append((at["dist"], at["node"]))
        at = reached.filter(F.col("node") == at["parent"]).first() if at["parent"] is not None else None
    return spark.createDataFrame(path, "pos int, node long")


def ego_nets(edges: DataFrame, queries: DataFrame, size: int = 500) -> DataFrame:
    """``query_id, node, dist``: the ``size`` vertices nearest to each query by (distance, id)."""
    reached = bfs(edges, queries, by=["query_id"])
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "node"))
    return reached.withColumn("_r", order).filter(F.col("_r") <= size).select("query_id", "node", "dist")


def cliques(edges: DataFrame, least: int = 2) -> DataFrame:
    """``clique`` (sorted array): all maximal cliques of ``least`` vertices or more.

    Cliques grow by one vertex in rising order; one is maximal if no vertex at all is adjacent to all its members. Both steps are joins on
    one member and counts of the others, level by level.
    """
    adj = stored(adjacency(edges), "adj")
    level = stored(edges.select(F.array("u", "v").alias("clique")), "cliques")
    found, size = None, 2
    while True:
        near = level.select("clique", F.explode("clique").alias("s")).join(adj, "s").groupBy("clique", "d").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == size)
        near = stored(near.select("clique", "d"), "near")
        done = stored(level.join(near.select("clique").distinct(), "clique", "left_anti"), "maximal")
        if size >= least:
            found = done if found is None else found.unionByName(done)
        level = stored(near.filter(F.col("d") > F.element_at("clique", -1)).select(F.concat("clique", F.array("d")).alias("clique")), "cliques")
        size += 1
        if level.isEmpty():
            return found if found is not None else level


def clique_overlaps(found: DataFrame) -> DataFrame:
    """``a, b, overlap``: pairs of cliques with common vertices; a clique's id is its place in array order."""
    members = found.select(F.col("clique").alias("a"), F.explode("clique").alias("node"))
    return members.join(members.withColumnRenamed("a", "b"), "node").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))


def spanning_forest(weighted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``u, v, w``: maximum spanning forest by rounds of largest edges (ties: least u, then v), within each group of the columns ``by``."""
    by = by or []
    edges = stored(weighted.select(*by, "u", "v", "w").withColumns({"cu": F.col("u"), "cv": F.col("v")}), "forest")
    chosen = None
    while True:
        ends = edges.select(*by, F.explode(F.array("cu", "cv")).alias("c"), F.struct(-F.col("w"), F.col("u"), F.col("v")).alias("k0"))
        best = ends.groupBy(*by, "c").agg(F.min("k0").alias("k0"))
        picked = stored(best.select(*by, F.col("k0.u").alias("u"), F.col("k0.v").alias("v"), (-F.col("k0.col1")).alias("w")).distinct(), "picked")
        if picked.isEmpty():
            return chosen if chosen is not None else weighted.select(*by, "u", "v", "w").limit(0)
        chosen = picked if chosen is None else chosen.unionByName(picked)
        joined = picked.join(edges.select(*by, "u", "v", "cu", "cv"), [*by, "u", "v"]).select(*by, F.col("cu").alias("u"), F.col("cv").alias("v"))
        label = components(joined, by=by)
        one, two = label.select(*by, F.col("node").alias("cu"), F.col("component").alias("nu")), label.select(*by, F.col("node").alias("cv"), F.col("component").alias("nv"))
        moved = edges.join(one, [*by, "cu"], "left").join(two, [*by, "cv"], "left").select(*by, "u", "v", "w", F.coalesce("nu", "cu").alias("cu"), F.coalesce("nv", "cv").alias("cv"))
        rest = stored(moved.filter("cu <> cv"), "forest")
        discard(edges)
        edges = rest


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, rounds: int = 10) -> DataFrame:
    """``node, rank`` after ``rounds`` power steps; with ``seeds`` (node), teleports go to them alone."""
    deg = degrees(edges)
    adj = stored(adjacency(edges).join(deg.select(F.col("node").alias("s"), F.col("degree").alias("ds")), "s"), "adj")
    if seeds is None:
        n = deg.count()
        start = deg.select("node", F.lit(1.0 / n).alias("home"))
    else:
        home = seeds.select("node").distinct()
        start = deg.select("node").join(home.select("node", F.lit(1.0 / max(1, home.count())).alias("home")), "node", "left").select("node", F.coalesce("home", F.lit(0.0)).alias("home"))
    start = stored(start, "home")
    rank = start.withColumnRenamed("home", "rank")
    for i in range(rounds):
        got = adj.join(rank.select(F.col("node").alias("s"), "rank"), "s").groupBy(F.col("d").alias("node")).agg(F.sum(F.col("rank") / F.col("ds")).alias("got"))
        rank = start.join(got, "node", "left").select("node", (alpha * F.coalesce("got", F.lit(0.0)) + (1 - alpha) * F.col("home")).alias("rank"))
        rank = stored(rank, "rank") if i % 2 else rank
    return rank


def proximity(edges: DataFrame, query: DataFrame, c: float = 0.85, rounds: int = 10) -> DataFrame:
    """``node, rank``: random walk with a sink, rank(q) = 1 and rank(v) = c times the mean rank of v's neighbours."""
    deg = degrees(edges)
    adj = stored(adjacency(edges), "adj")
    at = query.select("node").distinct().withColumn("q", F.lit(True))
    start = stored(deg.join(at, "node", "left").select("node", "degree", F.coalesce("q", F.lit(False)).alias("q")), "start")
    rank = start.select("node", F.when(F.col("q"), 1.0).otherwise(0.0).alias("rank"))
    for i in range(rounds):
        got = adj.join(rank.select(F.col("node").alias("d"), "rank"), "d").groupBy(F.col("s").alias("node")).agg(F.sum("rank").alias("got"))
        rank = start.join(got, "node", "left").select("node", F.when(F.col("q"), 1.0).otherwise(c * F.coalesce("got", F.lit(0.0)) / F.col("degree")).alias("rank"))
        rank = stored(rank, "rank") if i % 2 else rank
    return rank


def pagerank_each(edges: DataFrame, queries: DataFrame, alpha: float = 0.85, rounds: int = 10) -> DataFrame:
    """``query_id, node, rank``: personalised ranks of all queries in one pass. Only vertices that a query's walks reach have rows."""
    adj = adjacency(edges)
    adj = stored(adj.join(degrees(edges).select(F.col("node").alias("s"), F.col("degree").alias("ds")), "s"), "adj")
    home = queries.select("query_id", "node").distinct()
    home = stored(home.withColumn("rank", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("query_id"))), "home")
    rank = home
    for _ in range(rounds):
        got = rank.withColumnRenamed("node", "s").join(adj, "s").select("query_id", F.col("d").alias("node"), (alpha * F.col("rank") / F.col("ds")).alias("rank"))
        back = home.withColumn("rank", (1 - alpha) * F.col("rank"))
        rank = stored(got.unionByName(back).groupBy("query_id", "node").agg(F.sum("rank").alias("rank")), "rank")
    return rank


def proximity_each(edges: DataFrame, queries: DataFrame, c: float = 0.85, rounds: int = 10) -> DataFrame:
    """``query_id, node, rank``: ``proximity`` of all queries in one pass. Only vertices within ``rounds`` steps of a query have rows."""
    adj = adjacency(edges)
    adj = stored(adj.join(degrees(edges).select(F.col("node").alias("s"), F.col("degree").alias("ds")), "s"), "adj")
    home = stored(queries.select("query_id", "node").distinct().withColumn("rank", F.lit(1.0)), "home")
    rank = home
    for _ in range(rounds):
        got = rank.withColumnRenamed("node", "d").join(adj, "d").groupBy("query_id", F.col("s").alias("node"), "ds").agg(F.sum("rank").alias("sum"))
        rest = got.join(home.select("query_id", "node"), ["query_id", "node"], "left_anti").select("query_id", "node", (c * F.col("sum") / F.col("ds")).alias("rank"))
        rank = stored(rest.unionByName(home), "rank")
    return rank


def conductance_hops(edges: DataFrame, hops: int = 1) -> DataFrame:
    """``node, hop, excess, keep``: for walks of ``hop`` + 2 steps into a vertex, their number less the number of their starts; hops after the one
    with the largest excess (the first of equals) are not kept, unless that is hop 0.

    Walks are counted by passing sums along; only the reachable pairs are formed, so this is for a few hops.
    """
    adj = stored(adjacency(edges), "adj")
    walks = adj.groupBy(F.col("d").alias("node")).agg(F.count(F.lit(1)).alias("walks"))
    pairs, out = adj, None
    for hop in range(hops + 1):
        walks = stored(adj.join(walks.withColumnRenamed("node", "s"), "s").groupBy(F.col("d").alias("node")).agg(F.sum("walks").alias("walks")), "walks")
        pairs = stored(pairs.withColumnRenamed("d", "m").join(adj.withColumnRenamed("s", "m"), "m").select("s", "d").distinct(), "pairs")
        starts = pairs.groupBy(F.col("d").alias("node")).agg(F.count(F.lit(1)).alias("starts"))
        one = walks.join(starts, "node").select("node", F.lit(hop).alias("hop"), (F.col("walks") - F.col("starts")).alias("excess"))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("node").agg(F.min(F.struct(-F.col("excess"), "hop")).alias("b")).select("node", F.col("b.hop").alias("best"))
    return out.join(best, "node").select("node", "hop", "excess", F.when((F.col("hop") > F.col("best")) & (F.col("best") != 0), 0).otherwise(1).alias("keep"))


def biased_core(edges: DataFrame, weights: DataFrame, density: float) -> DataFrame:
    """``node``: what is left of the vertices of ``weights`` (node, w) after all with degree inside / w below ``density`` have gone, again and again."""
    left = stored(weights.select("node", F.col("w").cast("double").alias("w")), "left")
    inner = stored(induced(edges, left), "inner")
    while True:
        inside = degrees(inner)
        stay = stored(left.join(inside, "node", "left").filter(F.coalesce("degree", F.lit(0)) / F.col("w") >= density).select("node", "w"), "left")
        if stay.count() == left.count():
            return stay.select("node")
        left, inner = stay, stored(induced(inner, stay), "inner")


def propagate(edges: DataFrame, features: DataFrame, hops: int = 2, kind: str = "sym") -> DataFrame:
    """``node, hop, j, x``: features (node, j, x) spread by the normalised adjacency, all hops stacked."""
    weights = stored(normalised_adjacency(edges, kind), "weights")
    now = features.select("node", "j", "x")
    out = now.select("node", F.lit(0).alias("hop"), "j", "x")
    for h in range(1, hops + 1):
        now = weights.join(now.withColumnRenamed("node", "d"), "d").groupBy(F.col("s").alias("node"), "j").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        now = stored(now, "hop")
        out = out.unionByName(now.select("node", F.lit(h).alias("hop"), "j", "x"))
    return out


def contract(edges: DataFrame, nodes: DataFrame, name: int = -1) -> DataFrame:
    """``u, v, w``: the graph with all of ``nodes`` merged into the vertex ``name``; w counts merged edges."""
    inside = nodes.select(F.col("node")).withColumn("_in", F.lit(name))
    a = inside.select(F.col("node").alias("u"), F.col("_in").alias("_u"))
    b = inside.select(F.col("node").alias("v"), F.col("_in").alias("_v"))
    out = edges.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")).filter("u <> v")
    return out.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count(F.lit(1)).alias("w"))


def label_partition(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``node, part`` by synchronous label propagation: the most frequent label of the neighbours and oneself, ties to the least."""
    adj = stored(adjacency(edges), "adj")
    label = degrees(edges).select("node", F.col("node").alias("part"))
    for _ in range(rounds):
        votes = adj.join(label.select(F.col("node").alias("d"), "part"), "d").select(F.col("s").alias("node"), "part").unionByName(label)
        counted = votes.groupBy("node", "part").agg(F.count(F.lit(1)).alias("n"))
        label = stored(counted.groupBy("node").agg(F.min(F.struct(-F.col("n"), "part")).alias("m")).select("node", "m.part"), "parts")
    return label
