"""Quality of vertex sets: against ground truth, and by the structure of the graph. One row for each set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..plans.iterate import dealt
from .structure import adjacency, degrees


def overlaps(predicted: DataFrame, truth: DataFrame, key: str = "query_id") -> DataFrame:
    """``key, tp, n_pred, n_true`` for every key of either table."""
    pred, true = predicted.select(key, "node").distinct(), truth.select(key, "node").distinct()
    both = pred.withColumns({"p": F.lit(1), "t": F.lit(0)}).unionByName(true.withColumns({"p": F.lit(0), "t": F.lit(1)}))
    each = both.groupBy(key, "node").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    return each.groupBy(key).agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"))


def truth_metrics(predicted: DataFrame, truth: DataFrame, n_vertices: int, key: str = "query_id") -> DataFrame:
    """Precision, recall, F1, Jaccard, NMI and ARI over ``n_vertices``."""
    tp, p, t = F.col("tp"), F.col("n_pred"), F.col("n_true")
    fp, fn, tn = p - tp, t - tp, F.lit(n_vertices) - p - t + tp
    return overlaps(predicted, truth, key).select(
        key, X.precision(tp, p).alias("pre"), X.recall(tp, t).alias("rec"), X.f1(tp, p, t).alias("f1"), X.jaccard(tp, p, t).alias("jac"), X.nmi(tp, fp, fn, tn).alias("nmi"), X.ari(tp, fp, fn, tn).alias("ari")
    )


def set_counts(edges: DataFrame, sets: DataFrame, key: str = "community") -> DataFrame:
    """``key, n, vol, inner, cut, b_edges, b_inner``: members, degrees, edges inside and leaving; edges that touch a boundary member, all and inside.

    Every edge meets the sets of its ends by equi-joins; a boundary member is one with a neighbour outside.
    """
    member = sets.select(key, "node").distinct()
    size = member.join(degrees(edges), "node", "left").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).alias("vol"))
    out = adjacency(edges).join(member.withColumnRenamed("node", "s"), "s")
    out = out.join(member.select(key, F.col("node").alias("d"), F.lit(1).alias("inside")), [key, "d"], "left").select(key, "s", "d", F.coalesce("inside", F.lit(0)).alias("inside"))
    edge_sums = out.groupBy(key).agg((F.sum("inside") / 2).cast("long").alias("inner"), F.sum(1 - F.col("inside")).alias("cut"))
    border = out.filter("inside = 0").select(key, "s").distinct()
    marked = out.join(border.withColumn("bs", F.lit(1)), [key, "s"], "left").join(border.select(key, F.col("s").alias("d"), F.lit(1).alias("bd")), [key, "d"], "left")
    touch = (F.coalesce("bs", F.lit(0)) + F.coalesce("bd", F.lit(0)) > 0).cast("long")
    b = marked.groupBy(key).agg((F.sum(F.when(F.col("inside") == 1, touch).otherwise(0)) / 2).cast("long").alias("b_inner"), F.sum(F.when(F.col("inside") == 0, touch).otherwise(0)).alias("b_out"))
    zero = ["inner", "cut", "b_inner", "b_out"]
    joined = size.join(edge_sums, key, "left").join(b, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    return joined.select(key, "n", "vol", "inner", "cut", (F.col("b_inner") + F.col("b_out")).alias("b_edges"), "b_inner")


def structural_metrics(edges: DataFrame, sets: DataFrame, key: str = "community", counts: DataFrame | None = None) -> DataFrame:
    """All structural metrics of each set; guards give 0 as their definitions say. The number of edges is one aggregate over the graph."""
    m = edges.count()
    c = counts if counts is not None else set_counts(edges, sets, key)
    n, vol, inner, cut = (F.col(x).cast("double") for x in ("n", "vol", "inner", "cut"))
    return c.select(
        key,
        X.ratio(2 * inner, n).alias("avg_degree"),
        X.ratio(2 * inner, n * (n - 1)).alias("density"),
        F.col("n").cast("long").alias("size"),
        X.ratio(cut, F.least(vol, 2 * m - vol)).alias("conductance"),
        X.ratio(inner, F.lit(float(m))).__sub__(F.pow(X.ratio(vol, F.lit(2.0 * m)), F.lit(2.0))).alias("modularity"),
        (X.ratio(inner, n) - X.ratio(vol * vol, 4 * m * n)).alias("density_modularity"),
        X.ratio(F.col("b_inner").cast("double"), F.col("b_edges")).alias("local_modularity"),
        X.ratio(inner, cut).alias("subgraph_modularity"),
        (inner - n * (n - 1) / 6).alias("edge_surplus"),
    )


def separability(edges: DataFrame, sets: DataFrame, key: str = "community") -> DataFrame:
    """Edges inside over edges leaving; 999999 for closed sets with edges."""
    c = set_counts(edges, sets, key)
    return c.select(key, F.when(F.col("cut") > 0, F.col("inner") / F.col("cut")).when(F.col("inner") > 0, 999999.0).otherwise(0.0).alias("separability"))


def best_matches(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``f1, jac``: mean over truths of the best prediction, mean over predictions of the best truth, and the mean of both ways.

    Only pairs with common vertices are formed; a set without any has 0.
    """
    p, t = predicted.select(F.col("community").alias("p"), "node").distinct(), truth.select(F.col("community").alias("t"), "node").distinct()
    np_, nt = p.groupBy("p").agg(F.count(F.lit(1)).alias("np")), t.groupBy("t").agg(F.count(F.lit(1)).alias("nt"))
    pairs = p.join(t, "node").groupBy("p", "t").agg(F.count(F.lit(1)).alias("tp")).join(np_, "p").join(nt, "t")
    scored = pairs.select("p", "t", X.f1(F.col("tp"), F.col("np"), F.col("nt")).alias("f1"), X.jaccard(F.col("tp"), F.col("np"), F.col("nt")).alias("jac"))

    def side(all_sets, key):
        best = scored.groupBy(key).agg(F.max("f1").alias("f1"), F.max("jac").alias("jac"))
        return all_sets.join(best, key, "left").agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("f1"), F.avg(F.coalesce("jac", F.lit(0.0))).alias("jac"))

    both = side(np_, "p").unionByName(side(nt, "t"))
    return both.agg(F.avg("f1").alias("f1"), F.avg("jac").alias("jac"))


def soft_overlaps(scores: DataFrame, truth: DataFrame, at: float = 0.5) -> DataFrame:
    """``query_id, iou, f1``: sum of lesser over sum of greater of score and membership (0 or 1), and F1 of the scores above ``at``."""
    member = truth.select("query_id", "node").distinct().withColumns({"t": F.lit(1.0), "score": F.lit(0.0)})
    both = scores.select("query_id", "node", F.lit(0.0).alias("t"), "score").unionByName(member)
    both = dealt(both, scores.count(), "query_id", "node").groupBy("query_id", "node").agg(F.max("t").alias("t"), F.max("score").alias("x"))
    hit, true = (F.col("x") > at).cast("int"), F.col("t").cast("int")
    sums = both.groupBy("query_id").agg(F.sum(F.least("x", "t")).alias("low"), F.sum(F.greatest("x", "t")).alias("high"), F.sum(hit * true).alias("tp"), F.sum(hit).alias("n_pred"), F.sum(true).alias("n_true"))
    return sums.select("query_id", X.ratio(F.col("low"), F.col("high")).alias("iou"), X.f1(F.col("tp"), F.col("n_pred"), F.col("n_true")).alias("f1"))


def free_riders(edges: DataFrame, sets: DataFrame, weights: DataFrame) -> DataFrame:
    """``community, part, n, density, main``: connected parts of each set by edges over summed weights (node, w); all but the densest ride free. Ties go to the part with the smaller vertex."""
    from .prep import connected_parts
    from .structure import stored

    parts = stored(connected_parts(edges, sets, 1), "parts")
    a, b = parts.withColumnRenamed("node", "u"), parts.withColumnRenamed("node", "v")
    inner = edges.join(a, "u").join(b, ["community", "part", "v"]).groupBy("community", "part").agg(F.count(F.lit(1)).alias("inner"))
    sums = parts.join(weights.select("node", "w"), "node").groupBy("community", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    scored = sums.join(inner, ["community", "part"], "left").withColumn("density", X.ratio(F.coalesce("inner", F.lit(0)).cast("double"), F.col("w")))
    first = Window.partitionBy("community").orderBy(F.desc(F.round("density", 12)), "part")
    return scored.select("community", "part", "n", "density", (F.row_number().over(first) == 1).alias("main"))


def _distances(two: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``key, root, node, dist`` from roots (key, root) over the arcs ``two`` (key, s, d) of each set."""
    from .structure import stored

    seen = stored(roots.select(key, "root", F.col("root").alias("node"), F.lit(0).alias("dist")), "seen")
    front, dist = seen, 0
    while not front.isEmpty():
        dist += 1
        step = front.select(key, "root", F.col("node").alias("s")).join(two, [key, "s"]).select(key, "root", F.col("d").alias("node")).distinct()
        front = stored(step.join(seen.select(key, "root", "node"), [key, "root", "node"], "left_anti").withColumn("dist", F.lit(dist)), "front")
        seen = seen.unionByName(front)
        if dist % 8 == 0:
            seen = stored(seen, "seen")
    return stored(seen, "distances")


def diameters(edges: DataFrame, sets: DataFrame, key: str = "community", roots: int = 8, most: int = 64) -> DataFrame:
    """``key, diameter``: the longest shortest path inside each set; infinite where not all members are joined inside it, 0 for one member.

    Searches start from a few members of each set, not from all. A search from r with eccentricity e bounds that of a member at distance x
    to max(x, e - x) .. e + x. The next roots are, in turn, those of the largest upper and of the smallest lower bounds, until no upper
    bound exceeds the largest lower one. Roots double from ``roots`` to ``most`` a round, so a round holds at most ``most`` rows a member.
    """
    from .structure import discard, stored

    member = stored(sets.select(key, "node").distinct(), "members")
    inner = edges.filter("u <> v").join(member.withColumnRenamed("node", "u"), "u").join(member.withColumnRenamed("node", "v"), [key, "v"])
    two = inner.select(key, F.col("u").alias("s"), F.col("v").alias("d")).unionByName(inner.select(key, F.col("v").alias("s"), F.col("u").alias("d")))
    two = stored(two.distinct(), "arcs")
    size = two.groupBy(key, F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    none, n = F.lit(1 << 30), F.count(F.lit(1)).over(Window.partitionBy(key))
    # At first the roots are the members with most neighbours: the upper bounds are all alike.
    bounds = member.join(size, [key, "node"], "left").select(key, "node", F.coalesce("degree", F.lit(0)).alias("degree"), n.alias("n"), F.lit(0).alias("low"), none.alias("high"))
    bounds, done = stored(bounds, "bounds"), None
    while True:
        open_sets = bounds.groupBy(key).agg(F.max("low").alias("far"), F.max("high").alias("top"), F.max("n").alias("n"))
        closed = stored(open_sets.filter("top <= far").select(key, F.when(F.col("far") >= none, float("inf")).otherwise(F.col("far").cast("double")).alias("diameter")), "closed")
        done = closed if done is None else done.unionByName(closed)
        left = stored(bounds.join(open_sets.filter("top > far").select(key, "far"), key), "left")
        if left.isEmpty():
            return done
        by_high = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("high"), F.desc("degree"), "node"))
        by_low = F.row_number().over(Window.partitionBy(key).orderBy("low", F.desc("degree"), "node"))
        asked = left.filter("high > far").withColumns({"i": by_high, "j": by_low}).filter(f"i <= {(roots + 1) // 2} or j <= {roots // 2}").select(key, F.col("node").alias("root"))
        dist = _distances(two, stored(asked, "roots"), key)
        ends = dist.groupBy(key, "root").agg(F.max("dist").alias("ecc"), F.count(F.lit(1)).alias("reached"))
        near = dist.join(ends, [key, "root"]).groupBy(key, "node").agg(F.max(F.greatest("dist", F.col("ecc") - F.col("dist"))).alias("a"), F.min(F.col("ecc") + F.col("dist")).alias("b"), F.max(F.when(F.col("dist") == 0, F.col("ecc"))).alias("own"), F.min("reached").alias("reached"))
        met = left.join(near, [key, "node"], "left")
        apart = (F.coalesce("reached", F.lit(-1)) < F.col("n")).alias("apart")
        # A member that a search has not reached: the set is not joined, and both its bounds are infinite.
        low = F.when(apart, none).when(F.col("own").isNotNull(), F.col("own")).otherwise(F.greatest("low", "a"))
        high = F.when(apart, none).when(F.col("own").isNotNull(), F.col("own")).otherwise(F.least("high", "b"))
        after = stored(met.select(key, "node", "degree", "n", low.alias("low"), high.alias("high")), "bounds")
        for old in (bounds, left, dist):
            discard(old)
        bounds, roots = after, min(2 * roots, most)
