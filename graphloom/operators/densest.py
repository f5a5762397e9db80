"""Densest subgraphs of weighted vertices: batch peeling for a lower bound, trimming by it, then maximum flows that settle the rest exactly."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import discard, few, stored
from .structure import components

#: Edges of a group that one task solves; larger groups flow by joins. Shares below which loads count as none. Rounds of peeling, at most that of halving a double,
#: and of balancing in one task.
SMALL, TINY, ROUNDS = 1_000_000, 1e-9, 2000
#: Rounds of balancing at most, rounds from one look at the densities to the next, and how far below the best density met the flows begin.
BALANCE, LOOK, NEAR = 160, 20, 1e-7
#: Share of a round's move that the next one repeats. The same in all rounds, so that Spark compiles their code once.
MOMENTUM = 0.9


def _ends(links: DataFrame) -> DataFrame:
    """``g, node, w``: every link at both of its ends."""
    return links.select("g", F.explode(F.array("u", "v")).alias("node"), "w")


def _within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    one, two = nodes.select("g", F.col("node").alias("u")), nodes.select("g", F.col("node").alias("v"))
    return links.join(one, ["g", "u"], "left_semi").join(two, ["g", "v"], "left_semi").select("g", "u", "v", "w")


def density(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``g, rho``: weight of the links over weight of the vertices, of each group."""
    inside = links.groupBy("g").agg(F.sum("w").alias("e"))
    return nodes.groupBy("g").agg(F.sum("weight").alias("n")).join(inside, "g").select("g", (F.col("e") / F.col("n")).alias("rho"))


def peeled(links: DataFrame, nodes: DataFrame, step: float = 1.5) -> DataFrame:
    """``g, rho``: the best density met when again and again all vertices go whose degree over weight is at most ``step`` times twice the density.

    Each round leaves a fixed share of the vertices' weight at most, so rounds are logarithmic; the best density is at least the largest one over 2 ``step``.
    """
    links, nodes, best = stored(links, "links"), stored(nodes, "nodes"), None
    for _ in range(ROUNDS):
        rho = stored(density(links, nodes), "rho")
        if rho.isEmpty():
            break
        best = rho if best is None else stored(best.unionByName(rho).groupBy("g").agg(F.max("rho").alias("rho")), "best")
        degree = _ends(links).groupBy("g", "node").agg(F.sum("w").alias("d"))
        stay = nodes.join(degree, ["g", "node"]).join(rho, "g").filter(F.col("d") > 2 * step * F.col("rho") * F.col("weight")).select("g", "node", "weight")
        stay = stored(stay, "nodes")
        inner = stored(_within(links, stay), "links")
        discard(links)
        discard(nodes)
        links, nodes = inner, stay
    return best if best is not None else links.select("g", F.lit(0.0).alias("rho")).limit(0)


def trimmed(links: DataFrame, nodes: DataFrame, rho: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and vertices left when all of degree over weight below their group's ``rho`` have gone, again and again. Members of a densest part never go."""
    links, nodes = stored(links.join(rho.select("g"), "g", "left_semi"), "links"), stored(nodes.join(rho.select("g"), "g", "left_semi"), "nodes")
    while True:
        degree = _ends(links).groupBy("g", "node").agg(F.sum("w").alias("d"))
        judged = nodes.join(degree, ["g", "node"], "left").join(rho, "g").withColumn("stays", F.coalesce("d", F.lit(0)) >= F.col("rho") * F.col("weight") * (1 - TINY))
        stay = stored(judged.filter("stays").select("g", "node", "weight"), "nodes")
        if stay.count() == nodes.count():
            return links, stay
        inner = stored(_within(links, stay), "links")
        discard(links)
        discard(nodes)
        links, nodes = inner, stay


class _Flow:
    """Maximum flow by shortest augmenting layers over float capacities."""

    def __init__(self, n: int, tiny: float):
        self.out, self.to, self.room, self.tiny = [[] for _ in range(n)], [], [], tiny

    def arc(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def layers(self, s: int) -> list[int]:
        level, todo = [-1] * len(self.out), deque([s])
        level[s] = 0
        while todo:
            v = todo.popleft()
            for e in self.out[v]:
                if self.room[e] > self.tiny and level[self.to[e]] < 0:
                    level[self.to[e]] = level[v] + 1
                    todo.append(self.to[e])
        return level

    def run(self, s: int, t: int) -> list[int]:
        """Sends all that can be sent from s to t; the layers of what s still reaches."""
        while (level := self.layers(s))[t] >= 0:
            at, path = [0] * len(self.out), []
            while True:
                v = self.to[path[-1]] if path else s
                if v == t:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path = path[: next(i for i, e in enumerate(path) if self.room[e] <= self.tiny)]
                    continue
                while at[v] < len(self.out[v]):
                    e = self.out[v][at[v]]
                    if self.room[e] > self.tiny and level[self.to[e]] == level[v] + 1:
                        path.append(e)
                        break
                    at[v] += 1
                else:
                    if not path:
                        break
                    level[v] = -2
                    path.pop()
        return level


def _shares(u: np.ndarray, v: np.ndarray, w: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float, float]:
    """What ``balanced`` does, for one group in one task: the shares of u, the best density met and the largest load over weight."""
    n = len(weight)
    slope = (np.bincount(u, minlength=n) + np.bincount(v, minlength=n)) / weight
    step, x = 1 / (slope[u] + slope[v]), w / 2
    y, best, top = x, 0.0, np.inf
    for i in range(1, ROUNDS + 1):
        p = (np.bincount(u, y, n) + np.bincount(v, w - y, n)) / weight
        new = np.clip(y - step * (p[u] - p[v]), 0, w)
        x, y = new, new + MOMENTUM * (new - x)
        if i % LOOK == 0:
            p = (np.bincount(u, x, n) + np.bincount(v, w - x, n)) / weight
            order = np.argsort(-p, kind="stable")
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            inside = np.cumsum(np.bincount(np.maximum(place[u], place[v]), w, n))
            best, top = max(best, float((inside / np.cumsum(weight[order])).max())), float(p.max())
            if top <= best * (1 + TINY):
                break
    return x, best, top


def _solved(pdf: pd.DataFrame) -> pd.DataFrame:
    """The vertices of the largest densest part of one group. ``kind`` v: a vertex (u) and its weight (w); e: a link; r: the density to start from.

    Balanced shares bound all densities by their largest load, so a part that reaches the bound is settled; what they leave open flows settle.
    """
    g, kind = pdf.g.iloc[0], pdf.kind.to_numpy()
    own, links = pdf[kind == "v"], pdf[kind == "e"]
    node, place = np.unique(own.u.to_numpy(), return_index=True)
    weight, w = own.w.to_numpy()[place], links.w.to_numpy()
    u, v = np.searchsorted(node, links.u.to_numpy()), np.searchsorted(node, links.v.to_numpy())
    rho, met = float(pdf.w[kind == "r"].iloc[0]), 0.0
    while True:
        x, best, top = _shares(u, v, w, weight)
        if top <= met * (1 + TINY):
            return pd.DataFrame({"g": g, "node": node})
        rho = met or max(rho, best * (1 - NEAR))
        load, n = np.bincount(u, x, len(node)) + np.bincount(v, w - x, len(node)), len(node)
        flow = _Flow(n + 2, TINY * float(w.max(initial=0.0) or 1.0))
        for a, b, there, back in zip(u.tolist(), v.tolist(), x.tolist(), (w - x).tolist()):
            flow.arc(a, b, there, back)
        for i, over in enumerate((load - rho * weight).tolist()):
            flow.arc(n, i, over) if over > 0 else flow.arc(i, n + 1, -over)
        dense = np.array(flow.run(n, n + 1)[:n]) != -1
        inner = dense[u] & dense[v]
        inside = float(w[inner].sum())
        if not dense.any() or inside / float(weight[dense].sum()) <= rho * (1 + TINY):
            return pd.DataFrame({"g": g, "node": node})
        met = inside / float(weight[dense].sum())
        number = np.cumsum(dense) - 1
        node, weight, u, v, w = node[dense], weight[dense], number[u[inner]], number[v[inner]], w[inner]


def balanced(links: DataFrame, nodes: DataFrame, rounds: int = BALANCE) -> tuple[DataFrame, DataFrame | None]:
    """Shares of the links' weights (g, u, v, w, x; x is that of u) that make loads over weights nearly equal where they can be, and ``g, rho``: the best density met.

    Accelerated projected gradient steps on the sum of squared loads over weights, for all groups at once: one job a round, after the links are counted. The
    largest load over weight bounds every density from above, and the sets of vertices with loads close to it are held against it every ``LOOK`` rounds; rounds end when
    the two meet in all groups, or after ``rounds``. Any shares are a right start for ``overfull``, so a group that has not converged costs only time.
    """
    n = nodes.count()
    many = _ends(links).groupBy("g", "node").agg(F.count(F.lit(1)).alias("n")).join(nodes, ["g", "node"]).select("g", "node", "weight", (F.col("n") / F.col("weight")).alias("slope"))
    many = stored(many, "slopes")
    ends = [many.select("g", F.col("node").alias(c), F.col("slope").alias(f"s{c}")) for c in "uv"]
    state = links.join(few(ends[0], n), ["g", "u"]).join(few(ends[1], n), ["g", "v"])
    state = stored(state.select("g", "u", "v", "w", (1 / (F.col("su") + F.col("sv"))).alias("step"), (F.col("w") / 2).alias("x"), (F.col("w") / 2).alias("y")), "shares")

    def pressure(x: str) -> DataFrame:
        got = state.select("g", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col(x).alias("got")), F.struct(F.col("v").alias("node"), (F.col("w") - F.col(x)).alias("got")))).alias("e"))
        return got.groupBy("g", "e.node").agg(F.sum("e.got").alias("got")).join(few(many, n), ["g", "node"]).select("g", "node", "weight", (F.col("got") / F.col("weight")).alias("p"))

    best = None
    for i in range(1, rounds + 1):
        p = pressure("y").select("g", "node", "p")
        pu, pv = (p.select("g", F.col("node").alias(c), F.col("p").alias(f"p{c}")) for c in "uv")
        moved = state.join(few(pu, n), ["g", "u"]).join(few(pv, n), ["g", "v"])
        moved = moved.withColumn("new", F.greatest(F.lit(0.0), F.least(F.col("w"), F.col("y") - F.col("step") * (F.col("pu") - F.col("pv")))))
        moved = stored(moved.select("g", "u", "v", "w", "step", F.col("new").alias("x"), (F.col("new") + F.lit(MOMENTUM) * (F.col("new") - F.col("x"))).alias("y")), "shares")
        discard(state)
        state = moved
        if i % LOOK == 0 or i == rounds:
            p = stored(pressure("x"), "pressure")
            top = p.groupBy("g").agg(F.max("p").alias("top"))
            level = p.join(top, "g").select("g", "node", "weight", F.least(F.lit(50.0), F.ceil(-F.log2(F.greatest(F.lit(2.0**-50), 1 - F.col("p") / F.col("top"))))).cast("int").alias("k"))
            level = stored(level, "levels")
            lu, lv = (level.select("g", F.col("node").alias(c), F.col("k").alias(f"k{c}")) for c in "uv")
            inside = state.join(few(lu, n), ["g", "u"]).join(few(lv, n), ["g", "v"]).groupBy("g", F.least("ku", "kv").alias("k")).agg(F.sum("w").alias("e"), F.lit(0.0).alias("c"))
            falling = Window.partitionBy("g").orderBy(F.desc("k"))  # of one group, 51 rows at most
            tally = inside.unionByName(level.groupBy("g", "k").agg(F.lit(0.0).alias("e"), F.sum("weight").alias("c"))).groupBy("g", "k").agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
            here = tally.select("g", (F.sum("e").over(falling) / F.sum("c").over(falling)).alias("rho")).groupBy("g").agg(F.max("rho").alias("rho"))
            best = stored(here if best is None else best.unionByName(here).groupBy("g").agg(F.max("rho").alias("rho")), "best")
            if best.join(top, "g").filter(F.col("top") > F.col("rho") * (1 + TINY)).isEmpty():
                break
    return state.select("g", "u", "v", "w", "x"), best


def overfull(links: DataFrame, nodes: DataFrame, rho: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``g, node``: of each group the least set with the most link weight beyond ``rho`` times its vertices' weight; none where no set has any.

    Every link's weight is shared by its ends. Vertices with more than ``rho`` allows pass the excess along links whose share they hold, towards vertices with
    less, down distances to the nearest of these: distances anew in each phase, then one joint push a distance. When no excess reaches a vertex with room, the
    vertices that hold it and those reached from them are the set (a minimum cut). ``start``: shares (g, u, v, x) to begin with.
    """
    cap = stored(nodes.join(rho, "g").select("g", "node", (F.col("rho") * F.col("weight")).alias("cap")), "cap")
    cu, cv = cap.select("g", F.col("node").alias("u"), F.col("cap").alias("cu")), cap.select("g", F.col("node").alias("v"), F.col("cap").alias("cv"))
    if start is None:
        start = links.join(cu, ["g", "u"]).join(cv, ["g", "v"]).select("g", "u", "v", (F.col("w") * F.col("cu") / (F.col("cu") + F.col("cv"))).alias("x"))
    shares = stored(links.join(start.select("g", "u", "v", "x"), ["g", "u", "v"]), "shares")

    def arcs(shares: DataFrame) -> DataFrame:
        """``g, s, d, held``: what s may pass to d."""
        return shares.select("g", F.explode(F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("d"), F.col("x").alias("held")), F.struct(F.col("v").alias("s"), F.col("u").alias("d"), (F.col("w") - F.col("x")).alias("held")))).alias("a")).select("g", "a.*")

    def excess(shares: DataFrame) -> DataFrame:
        got = arcs(shares).groupBy("g", F.col("s").alias("node")).agg(F.sum("held").alias("got"))
        return cap.join(got, ["g", "node"], "left").select("g", "node", "cap", (F.coalesce("got", F.lit(0.0)) - F.col("cap")).alias("over"))

    def spread(start: DataFrame, usable: DataFrame) -> tuple[DataFrame, int]:
        """``g, node, h``: distance from ``start`` along ``usable`` (g, a, b), and the largest."""
        seen = front = stored(start.select("g", "node", F.lit(0).alias("h")), "seen")
        h = 0
        while True:
            step = front.select("g", F.col("node").alias("a")).join(usable, ["g", "a"]).select("g", F.col("b").alias("node")).distinct().join(seen, ["g", "node"], "left_anti")
            front = stored(step.select("g", "node", F.lit(h + 1).alias("h")), "front")
            if front.isEmpty():
                return seen, h
            seen, h = seen.unionByName(front), h + 1

    while True:
        state = stored(excess(shares), "excess")
        usable = stored(arcs(shares).filter(F.col("held") > TINY), "usable")
        high, top = spread(state.filter(F.col("over") < -TINY * F.col("cap")), usable.select("g", F.col("d").alias("a"), F.col("s").alias("b")))
        high = stored(high, "heights")
        if state.filter(F.col("over") > TINY * F.col("cap")).join(high.filter("h > 0"), ["g", "node"], "left_semi").isEmpty():
            full, _ = spread(state.filter(F.col("over") > TINY * F.col("cap")), usable.select("g", F.col("s").alias("a"), F.col("d").alias("b")))
            return full.select("g", "node")
        for h in range(top, 0, -1):
            over = excess(shares).filter(F.col("over") > 0).join(high.filter(F.col("h") == h).select("g", "node"), ["g", "node"], "left_semi").select("g", F.col("node").alias("s"), "over")
            down = arcs(shares).filter("held > 0").join(over, ["g", "s"]).join(high.filter(F.col("h") == h - 1).select("g", F.col("node").alias("d")), ["g", "d"], "left_semi")
            down = stored(down, "down")
            room = down.groupBy("g", "s").agg(F.sum("held").alias("all"))
            pushed = down.join(room, ["g", "s"]).select("g", F.least("s", "d").alias("u"), F.greatest("s", "d").alias("v"), (F.col("held") * F.least(F.lit(1.0), F.col("over") / F.col("all")) * F.when(F.col("s") < F.col("d"), -1).otherwise(1)).alias("move"))
            after = stored(shares.join(pushed, ["g", "u", "v"], "left").select("g", "u", "v", "w", (F.col("x") + F.coalesce("move", F.lit(0.0))).alias("x")), "shares")
            discard(shares)
            shares = after


def _by_parts(links: DataFrame, nodes: DataFrame, small: int) -> DataFrame:
    """``densest`` of groups by their connected parts: the densest sets of those parts that reach the largest density of their group."""
    part = components(links, by=["g"]).select("g", "node", F.concat_ws("|", F.col("g").cast("string"), "component").alias("part"))
    part = stored(part, "parts")
    inner = stored(links.join(part.withColumnRenamed("node", "u"), ["g", "u"]).select(F.col("part").alias("g"), "u", "v", "w"), "links")
    own = stored(nodes.join(part, ["g", "node"]).select(F.col("part").alias("g"), "node", "weight"), "nodes")
    found = stored(densest(inner, own, small, parts=False), "found")
    rho = density(_within(inner, found), own.join(found, ["g", "node"])).withColumnRenamed("g", "part").join(part.select("g", "part").distinct(), "part")
    rho = stored(rho, "rho")
    best = rho.join(rho.groupBy("g").agg(F.max("rho").alias("best")), "g").filter(F.col("rho") >= F.col("best") * (1 - TINY)).select("g", "part")
    return found.withColumnRenamed("g", "part").join(best, "part").select("g", "node")


def densest(links: DataFrame, nodes: DataFrame, small: int = SMALL, parts: bool = True) -> DataFrame:
    """``g, node``: of each group the largest vertex set of the largest link weight over vertex weight; groups without links have no rows.

    ``links`` (g, u, v, w) with u < v once each and w > 0, ``nodes`` (g, node, weight) with weights above 0; links to other vertices don't count. Peeling gives a
    density that trims the groups. From a little below it, sets that hold more than the density allows raise it (Dinkelbach), until none does; the last one
    is the largest densest set. Groups of ``small`` links at most are settled by one task each. Larger ones are taken apart into connected ``parts``; parts that are
    larger still are settled by ``overfull`` from ``balanced`` shares.
    """
    links, nodes = stored(links.select("g", "u", "v", F.col("w").cast("double").alias("w")), "links"), stored(nodes.select("g", "node", F.col("weight").cast("double").alias("weight")), "nodes")
    links = stored(_within(links, nodes), "links")
    rho = stored(peeled(links, nodes).select("g", (0.9 * F.col("rho")).alias("rho")), "rho")
    links, nodes = trimmed(links, nodes, rho)
    size = stored(links.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    few = size.filter(F.col("n") <= small).select("g")
    rows = links.select("g", F.lit("e").alias("kind"), "u", "v", "w").unionByName(nodes.select("g", F.lit("v").alias("kind"), F.col("node").alias("u"), F.col("node").alias("v"), F.col("weight").alias("w")))
    rows = rows.unionByName(rho.select("g", F.lit("r").alias("kind"), F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), F.col("rho").alias("w"))).join(few, "g", "left_semi")
    out = stored(rows.groupBy("g").applyInPandas(_solved, f"g {links.schema['g'].dataType.simpleString()}, node long"), "solved")
    big = size.filter(F.col("n") > small).select("g")
    now = stored(nodes.join(big, "g", "left_semi"), "now")
    if parts and not now.isEmpty():
        return out.unionByName(_by_parts(_within(links, now), now, small))
    rho, shares = rho.join(big, "g", "left_semi"), None
    if not now.isEmpty():
        shares, met = balanced(_within(links, now), now)
        rho = stored(rho.unionByName(met.select("g", (F.col("rho") * (1 - NEAR)).alias("rho"))).groupBy("g").agg(F.max("rho").alias("rho")), "rho")
    while not now.isEmpty():
        inner = stored(_within(links, now), "inner")
        dense = stored(overfull(inner, now, rho, shares).join(now, ["g", "node"]).select("g", "node", "weight"), "dense")
        better = density(_within(inner, dense), dense).join(rho.withColumnRenamed("rho", "old"), "g").filter(F.col("rho") > F.col("old") * (1 + TINY)).select("g", "rho")
        better = stored(better, "better")
        out = out.unionByName(now.join(better.select("g"), "g", "left_anti").select("g", "node"))
        now, rho = stored(dense.join(better.select("g"), "g", "left_semi"), "now"), better
    return out
