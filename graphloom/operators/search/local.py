"""Searches that grow or peel one query at a time: each query's candidate subgraph is a group, and the order of steps is fixed by smallest ids."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...plans.iterate import stored
from ..structure import bfs, degrees, proximity_each

#: Vertices of a query's first candidate subgraph: the nearest by (distance, id). A search that needs more is repeated with ``WIDER`` times as many.
CANDIDATES, WIDER = 500, 4
#: More than any graph's vertices: all that is reached.
ALL = 1 << 62
#: Pushes of one level of the approximate PageRank, at most (the reference has such a limit too).
PUSHES = 20_000


class Cut(Exception):
    """A search asked for all neighbours of a vertex that has neighbours outside the candidates."""


class Near(defaultdict):
    """Neighbours among the candidates. ``near[v] & c`` is exact for any candidates c; ``every(v)`` is all neighbours or raises ``Cut``."""

    def __init__(self, full: dict, whole: bool):
        super().__init__(set)
        self.full, self.whole = full, whole

    def every(self, v: int) -> set:
        if not self.whole and (v not in self.full or len(self[v]) < self.full[v]):
            raise Cut
        return self[v]


def _grouped(edges: DataFrame, queries: DataFrame, grow: Callable, size: int, extra: DataFrame | None = None, reached: DataFrame | None = None) -> DataFrame:
    """Runs ``grow(neighbours, full degrees, query, m, scores)`` for each query over the edges of its nearest vertices (or of those ``reached``).

    A search that needs a neighbour beyond its candidates is run again over more of them, so the result is that over the whole graph.
    """
    reached = bfs(edges, queries, by=["query_id"]) if reached is None else reached
    ranked = stored(reached.select("query_id", "node", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "node")).alias("_r")), "reached")
    deg, m = stored(degrees(edges), "degrees"), edges.count()
    asked, out = queries.select("query_id", "node").distinct(), None
    while True:
        ego = stored(ranked.filter(F.col("_r") <= size).select("query_id", "node"), "ego")
        found = stored(_round(edges, ego, deg, asked, grow, m, size, extra), "grown")
        done = found.filter("not cut").select("query_id", "node")
        out = done if out is None else out.unionByName(done)
        again = found.filter("cut").select("query_id")
        if again.isEmpty():
            return out
        asked, ranked, size = asked.join(again, "query_id", "left_semi"), ranked.join(again, "query_id", "left_semi"), WIDER * size


def _round(edges: DataFrame, ego: DataFrame, deg: DataFrame, queries: DataFrame, grow: Callable, m: int, size: int, extra: DataFrame | None) -> DataFrame:
    """``query_id, node, cut``: the communities found among the candidates ``ego``; one row with ``cut`` for a query that needs more of them."""
    inner = edges.join(ego.select("query_id", F.col("node").alias("u")), "u").join(ego.select("query_id", F.col("node").alias("v")), ["query_id", "v"]).select("query_id", F.lit("e").alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.lit(0.0).alias("x"))
    size_rows = ego.unionByName(queries).distinct().join(deg, "node", "left").select("query_id", F.lit("d").alias("kind"), F.col("node").alias("a"), F.coalesce("degree", F.lit(0)).alias("b"), F.lit(0.0).alias("x"))
    asked = queries.select("query_id", F.lit("q").alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("x"))
    rows = inner.unionByName(size_rows).unionByName(asked)
    if extra is not None:
        rows = rows.unionByName(extra.join(ego.select("query_id", "node"), ["query_id", "node"], "left_semi").select("query_id", F.lit("s").alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), F.col("score").alias("x")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        full = dict(zip(pdf.a[pdf.kind == "d"], pdf.b[pdf.kind == "d"]))
        nbrs, query, score = Near(full, len(full) < size), [], {}
        for kind, a, b, x in zip(pdf.kind, pdf.a, pdf.b, pdf.x):
            if kind == "e":
                nbrs[a].add(b)
                nbrs[b].add(a)
            elif kind == "q":
                query.append(a)
            elif kind == "s":
                score[a] = x
        try:
            nodes, cut = sorted(grow(nbrs, full, sorted(set(query)), m, score)), False
        except Cut:
            nodes, cut = query[:1], True
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "node": nodes, "cut": cut})

    return rows.groupBy("query_id").applyInPandas(run, "query_id long, node long, cut boolean")


def local_modularity(edges: DataFrame, queries: DataFrame, k: int = 20, size: int = CANDIDATES) -> DataFrame:
    """Grows to k vertices by the neighbour with the largest change of local modularity R = I / T over edges that touch the border, the least id of equals."""

    def grow(nbrs, full, query, m, score):
        c, closed, inside = set(query), set(), {}  # closed: members without a neighbour outside; inside: neighbours among the members
        for v in c:
            for w in nbrs.every(v):
                inside[w] = inside.get(w, 0) + 1
        closed = {v for v in c if full[v] == inside.get(v, 0)}
        within = sum(inside.get(v, 0) for v in c) // 2
        deep, out = sum(len(nbrs[v] & closed) for v in closed) // 2, sum(full[v] for v in c) - 2 * within

        def after(w: int) -> tuple[int, int, set]:
            """Edges between closed members, edges that leave, and the members that close, once w has joined."""
            closing = {v for v in nbrs[w] & c if full[v] == inside.get(v, 0) + 1} | ({w} if full[w] == inside[w] else set())
            return deep + sum(len(nbrs[v] & closed) for v in closing) + sum(len(nbrs[v] & closing) for v in closing) // 2, out + full[w] - 2 * inside[w], closing

        def ratio(w: int) -> float:
            deep_, out_, _ = after(w)
            touching = within + inside[w] - deep_
            return touching / (touching + out_) if touching + out_ else 0.0

        while len(c) < k:
            shell = inside.keys() - c
            if not shell:
                break
            w = min(shell, key=lambda w: (-ratio(w), w))
            deep, out, closing = after(w)
            within += inside[w]
            closed |= closing
            c.add(w)
            if len(c) < k:
                for x in nbrs.every(w):
                    inside[x] = inside.get(x, 0) + 1
        return c

    return _grouped(edges, queries, grow, size)


def subgraph_modularity(edges: DataFrame, queries: DataFrame, size: int = CANDIDATES, pinned: bool = False) -> DataFrame:
    """Adds neighbours, then removes members, in falling (degree, id) order while edges inside over edges leaving rises and the rest stays connected.

    Any member may go, the query too; with ``pinned`` the query stays.
    """

    def value(ins: int, out: int) -> float:
        return ins / out if out else math.inf

    def connected(c: set, nbrs: dict) -> bool:
        start = next(iter(c))
        seen, stack = {start}, [start]
        while stack:
            for w in nbrs[stack.pop()] & c - seen:
                seen.add(w)
                stack.append(w)
        return len(seen) == len(c)

    def grow(nbrs, full, query, m, score):
        c, keep = set(query), set(query) if pinned else set()
        ins = sum(len(nbrs[v] & c) for v in c) // 2
        out = sum(full[v] for v in c) - 2 * ins
        while True:  # the value rises with every move
            moved = False
            for w in sorted({w for v in c for w in nbrs.every(v)} - c, key=lambda w: (-full[w], -w)):
                inside = len(nbrs[w] & c)
                i, o = ins + inside, out + full[w] - 2 * inside
                if value(i, o) > value(ins, out):
                    c.add(w)
                    ins, out, moved = i, o, True
            for v in sorted(c - keep, key=lambda w: (-full[w], -w)):
                inside = len(nbrs[v] & c)
                i, o = ins - inside, out - full[v] + 2 * inside
                if len(c) > 1 and value(i, o) > value(ins, out) and connected(c - {v}, nbrs):
                    c.remove(v)
                    ins, out, moved = i, o, True
            if not moved or not out:
                break
        return c

    return _grouped(edges, queries, grow, size)


def _path_union(nbrs: Near, query: list) -> set:
    """The query joined by shortest paths (least parents) from its first vertex."""
    parent, todo, missing = {query[0]: None}, deque([query[0]]), set(query[1:])
    while todo and missing - parent.keys():
        v = todo.popleft()
        for w in sorted(nbrs.every(v)):
            if w not in parent:
                parent[w] = v
                todo.append(w)
    out = set(query)
    for q in query:
        while q is not None and q in parent:
            out.add(q)
            q = parent[q]
    return out


def density_modularity(edges: DataFrame, queries: DataFrame, size: int = CANDIDATES) -> DataFrame:
    """Peels layers, then vertices of the outermost layer by largest (degree in the graph / degree left), keeping the set of the best density modularity.

    Layers are compared by joins over all that is reached; one group for each query then peels the layers within the best one.
    """

    core = _grouped(edges, queries, lambda nbrs, full, query, m, score: _path_union(nbrs, query), size)
    dist, m = stored(bfs(edges, core, by=["query_id"]).select("query_id", "node", "dist"), "layers"), edges.count()
    ends = edges.join(dist.select("query_id", F.col("node").alias("u"), F.col("dist").alias("du")), "u").join(dist.select("query_id", F.col("node").alias("v"), F.col("dist").alias("dv")), ["query_id", "v"])
    inner = ends.groupBy("query_id", F.greatest("du", "dv").alias("dist")).agg(F.count(F.lit(1)).alias("e"))
    layers = dist.join(degrees(edges), "node", "left").groupBy("query_id", "dist").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("degree", F.lit(0))).alias("vol"))
    upto = Window.partitionBy("query_id").orderBy("dist").rowsBetween(Window.unboundedPreceding, 0)
    n, e, vol = (F.sum(F.coalesce(x, F.lit(0))).over(upto).cast("double") for x in ("n", "e", "vol"))
    value = e / n - vol * vol / (4 * m * n) if m else F.lit(0.0)
    best = layers.join(inner, ["query_id", "dist"], "left").select("query_id", "dist", value.alias("dm")).groupBy("query_id").agg(F.max(F.struct("dm", -F.col("dist"))).alias("k")).select("query_id", (-F.col("k.col2")).alias("best"))
    inside = stored(dist.join(best, "query_id").filter("dist <= best"), "inside")

    def grow(nbrs, full, query, m, score):
        def dm(n: int, e: float, vol: float) -> float:
            return e / n - vol * vol / (4 * m * n) if n and m else 0.0

        dist = {v: int(far) for v, far in score.items()}
        c = set(dist)
        n, e, vol = len(c), sum(len(nbrs[v] & c) for v in c) / 2, sum(full[v] for v in c)
        top, answer = dm(n, e, vol), set(c)
        for far in range(max(dist.values()), 0, -1):
            layer = {v for v in c if dist[v] == far}
            while layer:
                v = min(layer, key=lambda x: (-(full[x] / max(1, len(nbrs[x] & c))), x))
                layer.remove(v)
                inside = len(nbrs[v] & c)
                c.remove(v)
                n, e, vol = n - 1, e - inside, vol - full[v]
                if dm(n, e, vol) > top:
                    top, answer = dm(n, e, vol), set(c)
        return answer | set(query)

    return _grouped(edges, queries, grow, ALL, inside.select("query_id", "node", F.col("dist").cast("double").alias("score")), inside)


def query_biased_density(edges: DataFrame, queries: DataFrame, k: float = 20, c: float = 0.85, rounds: int = 10, size: int = CANDIDATES) -> DataFrame:
    """Grows from the joined query by the most (neighbours inside x proximity) up to k + 1 vertices; the prefix with most edges per summed weight 1 / proximity wins."""
    scores = proximity_each(edges, queries, c, rounds).withColumnRenamed("rank", "score")

    def grow(nbrs, full, query, m, score):
        weight = lambda v: 1 / max(score.get(v, 0.0), 1e-8)
        members = sorted(_path_union(nbrs, query))
        inside = set(members)
        e = sum(len(nbrs[v] & inside) for v in inside) / 2
        w = sum(map(weight, inside))
        best, answer = e / w, set(inside)
        while len(inside) <= k:
            shell = {x for v in inside for x in nbrs.every(v)} - inside
            if not shell:
                break
            v = min(shell, key=lambda x: (-(len(nbrs[x] & inside) / weight(x)), x))
            e, w = e + len(nbrs[v] & inside), w + weight(v)
            inside.add(v)
            if e / w > best:
                best, answer = e / w, set(inside)
        return answer

    return _grouped(edges, queries, grow, size, scores)


def ppr_nibble(edges: DataFrame, queries: DataFrame, phi: float = 0.3, size: int = CANDIDATES) -> DataFrame:
    """Approximate personalised PageRank by pushes from the first query vertex, then the first sweep prefix that holds the query and meets volume, conductance and gap.

    Every level starts anew with its own epsilon. The gap is the mass between the volume marks 2^(b-1) and 2^b, interpolated within the vertex that
    passes a mark; a prefix that has not passed both has no gap. The sweep takes vertices with mass only, ties by smallest id.
    """

    def grow(nbrs, full, query, m, score):
        q = query[0]
        if m < 2:
            return {q}
        top = max(1, math.ceil(math.log2(m)))
        alpha = max(phi * phi / (225 * math.log2(100 * math.sqrt(m))), 0.01)
        near: dict[int, list] = {}
        for b in range(1, top + 1):
            p, r = defaultdict(float), defaultdict(float, {q: 1.0})
            eps = max(1 / (2**b * 48 * top), 1e-10)
            todo = deque(sorted(v for v in r if full.get(v) and r[v] >= eps * full[v]))
            for _ in range(PUSHES):
                if not todo:
                    break
                v = todo.popleft()
                d, rest = full[v], r[v]
                if rest < eps * d:
                    continue
                p[v] += alpha * rest
                r[v] = (1 - alpha) * rest / 2
                move = (1 - alpha) * rest / (2 * d)
                if v not in near:
                    near[v] = sorted(nbrs.every(v))
                for w in near[v]:
                    before = r[w]
                    r[w] = before + move
                    if before < eps * full[w] <= r[w]:
                        todo.append(w)
                if r[v] >= eps * d:
                    todo.append(v)
            order = sorted((v for v in p if full.get(v)), key=lambda v: (-p[v] / full[v], v))
            half, whole = 2 ** (b - 1), 2**b
            vol, cut, c, mass, marks = 0, 0, set(), 0.0, {}
            for v in order:
                for mark in (half, whole):
                    if vol < mark <= vol + full[v]:
                        marks[mark] = mass + (mark - vol) / full[v] * p[v]
                cut += full[v] - 2 * len(nbrs[v] & c)
                c.add(v)
                vol, mass = vol + full[v], mass + p[v]
                side = min(vol, 2 * m - vol)
                gap = whole in marks and marks[whole] - marks[half] > 1 / (48 * top)
                if half < vol < 2 / 3 * 2 * m and side and cut / side < phi and gap and q in c:
                    return c
        return {q}

    return _grouped(edges, queries, grow, size)
