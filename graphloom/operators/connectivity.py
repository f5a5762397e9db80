"""Edge connectivity of every edge by certificates: all levels at once, contraction and cuts as joins, and bounded leftovers by maximum adjacency orders."""

from __future__ import annotations

import functools
import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import discard, stored
from .structure import components, core_numbers, spanning_forest

#: Contracted edges of a leftover that one task takes; larger ones are contracted by forests first, ``TRIES`` times at most with nothing found.
LEFTOVER, TRIES = 100_000, 4


def _bundled(multi: DataFrame) -> DataFrame:
    """``k, a, b, w`` with a < b and without loops: parallel edges as one with their number."""
    return multi.filter("a <> b").groupBy("k", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))


def _renamed(multi: DataFrame, into: DataFrame) -> DataFrame:
    """``multi`` with its ends moved to the component that ``into`` (k, node, component) names."""
    one, two = into.select("k", F.col("node").alias("a"), F.col("component").alias("ca")), into.select("k", F.col("node").alias("b"), F.col("component").alias("cb"))
    moved = multi.join(one, ["k", "a"], "left").join(two, ["k", "b"], "left")
    return _bundled(moved.select("k", F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), "w"))


def short_paths(multi: DataFrame) -> DataFrame:
    """``k, u, v``: neighbours that k disjoint paths of one or two edges join; a vertex between gives as many as the weaker of its two bundles has.

    Triangles are listed along edges from the end with fewer neighbours, so a vertex with many neighbours is no hot key.
    """
    deg = multi.select("k", F.explode(F.array("a", "b")).alias("x")).groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    ends = multi.join(deg.select("k", F.col("x").alias("a"), F.col("n").alias("na")), ["k", "a"]).join(deg.select("k", F.col("x").alias("b"), F.col("n").alias("nb")), ["k", "b"])
    up = F.struct("na", "a") < F.struct("nb", "b")
    out = stored(ends.select("k", F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"), "w"), "outward")
    wedge = out.select("k", "x", "y", F.col("w").alias("xy")).join(out.select("k", "x", F.col("y").alias("z"), F.col("w").alias("xz")), ["k", "x"]).filter("y < z")
    closed = wedge.join(multi.select("k", F.col("a").alias("y"), F.col("b").alias("z"), F.col("w").alias("yz")), ["k", "y", "z"])
    side = lambda p, q, r, s: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.least(r, s).alias("w"))
    each = closed.select("k", F.explode(F.array(side("x", "y", "xz", "yz"), side("x", "z", "xy", "yz"), side("y", "z", "xy", "xz"))).alias("e")).select("k", "e.*")
    sums = each.unionByName(multi.select("k", F.col("a").alias("u"), F.col("b").alias("v"), "w")).groupBy("k", "u", "v").agg(F.sum("w").alias("w"))
    return sums.filter("w >= k").select("k", "u", "v")


def beyond_forests(multi: DataFrame, seed: int = 0) -> DataFrame:
    """``k, u, v``: edges left when k - 1 maximal spanning forests have been taken out one after another; their ends are k-edge-connected.

    Each such forest joins both ends by a path of its own, and the edge itself is one more. Forests of hashed weights, each level's up to its own number.
    """
    rest, top, taken = stored(multi, "rest"), multi.agg(F.max("k")).first()[0] or 1, 1
    while taken < top:
        weight = F.abs(F.xxhash64(F.lit(seed), F.lit(taken), "a", "b"))
        forest = spanning_forest(rest.filter(F.col("k") > taken).select("k", F.col("a").alias("u"), F.col("b").alias("v"), weight.alias("w")), by=["k"])
        once = forest.select("k", F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).alias("one"))
        left = stored(rest.join(once, ["k", "a", "b"], "left").withColumn("w", F.col("w") - F.coalesce("one", F.lit(0))).filter("w > 0").drop("one"), "rest")
        discard(rest)
        rest, taken = left, taken + 1
    return rest.select("k", F.col("a").alias("u"), F.col("b").alias("v"))


def _small_cut(weight: dict[int, dict[int, int]], k: int) -> set | None:
    """One side of a cut of fewer than k edges, or None.

    In a maximum adjacency order, a vertex that joins with a weight of k or more is k-connected to the one before it: all such pairs
    merge in one pass, so few passes are needed. A last vertex that joins with less is a side of a cut.
    """
    group = {v: {v} for v in weight}
    while len(weight) > 1:
        gain, done, heap, order = dict.fromkeys(weight, 0), set(), [(0, min(weight))], []
        while heap:
            g, v = heapq.heappop(heap)
            if v in done or -g != gain[v]:
                continue
            done.add(v)
            order.append(v)
            for w, c in weight[v].items():
                if w not in done:
                    gain[w] += c
                    heapq.heappush(heap, (-gain[w], w))
        if len(order) < len(weight):  # not connected: what was reached is a side
            return set().union(*(group[v] for v in order))
        if gain[order[-1]] < k:
            return group[order[-1]]
        into: dict = {}
        for u, v in zip(order, order[1:]):
            if gain[v] >= k:
                into[v] = into.get(u, u)
        merged: dict = {}
        for v, row in weight.items():
            mine = merged.setdefault(into.get(v, v), defaultdict(int))
            for w, c in row.items():
                if into.get(w, w) != into.get(v, v):
                    mine[into.get(w, w)] += c
        for v, r in into.items():
            group[r] |= group.pop(v)
        weight = merged
    return None


def _parts(whole: dict[int, dict[int, int]], k: int) -> list[set]:
    """The parts of a graph that are left when cuts of fewer than k edges are made until there is none."""
    todo, out = [set(whole)], []
    while todo:
        part = todo.pop()
        side = _small_cut({v: {w: c for w, c in whole[v].items() if w in part} for v in part}, k) if len(part) > 1 else None
        if side is None:
            out.append(part)
        else:
            todo += [side, part - side]
    return out


def _neighbours(a: list[int], b: list[int], w: list[int]) -> dict[int, dict[int, int]]:
    whole: dict = defaultdict(dict)
    for x, y, n in zip(a, b, w):
        whole[x][y] = whole[y][x] = n
    return whole


def _sides(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one leftover: its vertices with the least vertex of their part."""
    k = int(pdf.k.iloc[0])
    return pd.DataFrame([(k, v, min(part)) for part in _parts(_neighbours(pdf.a.tolist(), pdf.b.tolist(), pdf.w.tolist()), k) for v in part], columns=["k", "node", "component"])


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one small part: its edges that lie in k-edge-connected parts."""
    k, u, v = int(pdf.k.iloc[0]), pdf.u.tolist(), pdf.v.tolist()
    at = {x: i for i, part in enumerate(_parts(_neighbours(u, v, [1] * len(u)), k)) for x in part}
    return pd.DataFrame([(x, y, k) for x, y in zip(u, v) if at[x] == at[y]], columns=["u", "v", "w"])


def _contracted(alive: DataFrame, leftover: int) -> DataFrame:
    """``k, node, component``: each vertex of the links ``alive`` (k, u, v) in the group where contraction and cuts of one pass leave it.

    Until no link is left: neighbours with k short disjoint paths merge, vertices with fewer than k links are cut off. Where neither occurs,
    spanning forests (for what is larger than ``leftover``), or else one task for each component, decide.
    """
    multi = stored(_bundled(alive.select("k", F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).cast("long").alias("w"))), "multi")
    groups = stored(alive.select("k", F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")), "groups")
    barren = 0

    def merged(into: DataFrame, multi: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        held = groups.join(into.select("k", F.col("node").alias("component"), F.col("component").alias("to")), ["k", "component"], "left")
        new = stored(held.select("k", "node", F.coalesce("to", "component").alias("component")), "groups")
        rest = stored(_renamed(multi, into), "multi")
        discard(groups)
        discard(multi)
        return rest, new

    while True:
        thin = multi.select("k", F.explode(F.array("a", "b")).alias("x"), "w").groupBy("k", "x").agg(F.sum("w").alias("n")).filter("n < k").select("k", "x")
        thin = stored(thin, "thin")
        if not thin.isEmpty():
            kept = multi.join(thin.withColumnRenamed("x", "a"), ["k", "a"], "left_anti").join(thin.withColumnRenamed("x", "b"), ["k", "b"], "left_anti")
            rest = stored(kept.select("k", "a", "b", "w"), "multi")
            discard(multi)
            multi = rest
            continue
        if multi.isEmpty():
            return groups
        sure = stored(short_paths(multi), "sure")
        if sure.isEmpty():
            label = stored(components(multi.select("k", F.col("a").alias("u"), F.col("b").alias("v")), by=["k"]), "parts")
            placed = stored(multi.join(label.select("k", F.col("node").alias("a"), "component"), ["k", "a"]), "placed")
            size = placed.groupBy("k", "component").agg(F.count(F.lit(1)).alias("n"))
            large = placed.join(size.filter(F.col("n") > leftover), ["k", "component"], "left_semi").select("k", "a", "b", "w")
            if barren < TRIES and not large.isEmpty():
                barren += 1
                sure = stored(beyond_forests(large, barren), "sure")
                if sure.isEmpty():
                    continue
            else:
                sides = stored(placed.groupBy("k", "component").applyInPandas(_sides, "k int, node long, component long"), "sides")
                held = groups.join(sides.select("k", F.col("node").alias("component"), F.col("component").alias("to")), ["k", "component"], "left")
                return stored(held.select("k", "node", F.coalesce("to", "component").alias("component")), "groups")
        barren = 0
        multi, groups = merged(stored(components(sure, by=["k"]), "into"), multi, groups)


def edge_connectivity(edges: DataFrame, leftover: int = LEFTOVER) -> DataFrame:
    """``u, v, w``: for each edge the largest k for which both ends lie in one k-edge-connected part (a part that no removal of fewer than k edges parts).

    All levels up to the largest core number go together, each from its own core. Parts of ``leftover`` edges at most are settled by one task each, which
    bounds a task's rows. Larger parts are contracted: ends that k edge-disjoint paths join become one, and cuts of fewer than k edges are made; a part that
    shrinks to one vertex is settled, one in which cuts were made starts anew without the edges cut, as what was merged may have needed them. All of that is
    joins and partial sums; only what no certificate can shrink is taken by one task whatever its size. Empty graph: no rows.
    """
    plain = stored(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "plain")
    cores = core_numbers(plain)
    weak = plain.join(cores.select(F.col("node").alias("u"), F.col("core").alias("cu")), "u").join(cores.select(F.col("node").alias("v"), F.col("core").alias("cv")), "v")
    levels = F.when(F.least("cu", "cv") >= 2, F.sequence(F.lit(2), F.least("cu", "cv").cast("int")))
    alive, best = stored(weak.select("u", "v", F.explode(levels).alias("k")).select("k", "u", "v"), "alive"), []
    while not alive.isEmpty():
        part = components(alive, by=["k"])
        placed = stored(alive.join(part.select("k", F.col("node").alias("u"), F.col("component").alias("part")), ["k", "u"]), "placed")
        size = stored(placed.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")), "sizes")
        few = placed.join(size.filter(F.col("n") <= leftover), ["k", "part"], "left_semi")
        best.append(stored(few.groupBy("k", "part").applyInPandas(_settled, "u long, v long, w int"), "settled"))
        large = stored(placed.join(size.filter(F.col("n") > leftover), ["k", "part"], "left_semi").select("k", "part", "u", "v"), "large")
        for old in (alive, placed, size):
            discard(old)
        if large.isEmpty():
            break
        groups = _contracted(large.select("k", "u", "v"), leftover)
        one, two = groups.select("k", F.col("node").alias("u"), F.col("component").alias("gu")), groups.select("k", F.col("node").alias("v"), F.col("component").alias("gv"))
        ends = stored(large.join(one, ["k", "u"]).join(two, ["k", "v"]), "ends")
        parted = ends.groupBy("k", "part").agg((F.min(F.least("gu", "gv")) == F.max(F.greatest("gu", "gv"))).alias("whole"))
        ends = ends.filter("gu = gv").join(parted, ["k", "part"])
        best.append(stored(ends.filter("whole").select("u", "v", F.col("k").alias("w")), "settled"))
        alive = stored(ends.filter("not whole").select("k", "u", "v"), "alive")
    if not best:
        return plain.withColumn("w", F.lit(1))
    top = functools.reduce(DataFrame.unionByName, best).groupBy("u", "v").agg(F.max("w").alias("w"))
    return plain.join(top, ["u", "v"], "left").select("u", "v", F.coalesce("w", F.lit(1)).alias("w"))
