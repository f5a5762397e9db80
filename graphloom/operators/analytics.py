"""Statistics of communities, comparison of methods by measured results, and tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from .metrics import set_counts


def community_stats(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """``community, size, inner_edges, density``."""
    c = set_counts(edges, communities)
    return c.select("community", F.col("n").alias("size"), F.col("inner").alias("inner_edges"), ratio(2.0 * F.col("inner"), F.col("n") * (F.col("n") - 1)).alias("density"))


def stats_summary(stats: DataFrame, *by: str) -> DataFrame:
    """Count, and least, largest, mean and median of size and density, to 4 digits; for each group of the columns ``by``."""
    out = [F.count(F.lit(1)).alias("n_communities")]
    for c in ("size", "density"):
        x = F.col(c).cast("double")
        out += [F.round(f, 4).alias(f"{c}_{n}") for n, f in (("min", F.min(x)), ("max", F.max(x)), ("mean", F.avg(x)), ("median", F.percentile(x, F.lit(0.5))))]
    return stats.groupBy(*by).agg(*out)


def distinct_communities(members: DataFrame, key: str = "community") -> DataFrame:
    """``members`` (key, node) of the first of each class of communities with equal vertices."""
    sets = members.groupBy(key).agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    kept = sets.groupBy("nodes").agg(F.min(key).alias(key)).select(key)
    return members.join(kept, key, "left_semi").select(key, "node").distinct()


def class_sizes(labels: DataFrame, column: str) -> DataFrame:
    """``column, n``: how many rows each component, shell or truss class has."""
    return labels.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def layout_sizes(stats: DataFrame, by: str) -> DataFrame:
    """``stats`` (size, density) with what a drawing of them needs: ``radius``, the fifth root of the size over the largest of its group, and ``fill``, density likewise."""
    out = scaled_by_max(scaled_by_max(stats, "size", by), "density", by)
    return out.withColumns({"radius": F.pow("size_norm", F.lit(0.2)), "fill": F.col("density_norm")}).drop("size_norm", "density_norm")


def scaled_by_max(stats: DataFrame, column: str, by: str) -> DataFrame:
    """``<column>_norm``: over the largest of its group, 1 where that is nearly 0."""
    top = F.max(column).over(Window.partitionBy(by))
    return stats.withColumn(f"{column}_norm", F.when(top < 1e-10, 1.0).otherwise(F.col(column) / top))


def best_methods(results: DataFrame, methods: DataFrame | None = None, exclusive: bool = False) -> DataFrame:
    """``method, n_best, pct``: queries on which a method has the largest F1, ties for all (or none, if ``exclusive``), and its share of all such counts in %."""
    w = Window.partitionBy("query")
    best = results.withColumn("top", F.max("f1").over(w)).filter("f1 = top")
    if exclusive:
        best = best.withColumn("n", F.count(F.lit(1)).over(w)).filter("n = 1")
    counts = best.groupBy("method").agg(F.count(F.lit(1)).alias("n_best"))
    methods = results.select("method").distinct() if methods is None else methods.select("method")
    out = methods.join(counts, "method", "left").select("method", F.coalesce("n_best", F.lit(0)).alias("n_best"))
    total = F.sum("n_best").over(Window.partitionBy(F.lit(0)))  # one row for each method
    return out.withColumn("pct", F.round(ratio(100.0 * F.col("n_best"), total), 3))


QUANTILES = (0.2, 0.4, 0.6, 0.8, 1.0)


def rank_quantiles(values: DataFrame, column: str, quantiles=QUANTILES) -> DataFrame:
    """``q, threshold``: of the distinct finite values, those of rank int(n q) - 1 from 0 (0 at least), the last always; all of them if there are no more than there are quantiles."""
    finite = values.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")) & (F.abs(column) != float("inf"))).select(F.col(column).cast("double").alias("x")).distinct()
    # Distinct thresholds of a property such as size: counted once, then found by rank.
    w = Window.partitionBy(F.lit(0))
    ranked = finite.select("x", (F.row_number().over(w.orderBy("x")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    k = len(quantiles)
    spots = ranked.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles])))
    at = F.when(F.col("q") == F.lit(quantiles[-1]), F.col("n") - 1).otherwise(F.greatest(F.lit(0), F.floor(F.col("n") * F.col("q")) - 1))
    many = spots.filter((F.col("n") > k) & (F.col("i") == at)).select("q", "x")
    few = ranked.filter(F.col("n") <= k).select(((F.col("i") + 1) / F.col("n")).alias("q"), "x")
    return many.unionByName(few).select("q", F.col("x").alias("threshold"))


def cumulative_by_property(results: DataFrame, prop: DataFrame, column: str, thresholds: DataFrame) -> DataFrame:
    """``method, threshold, n, mean_f1`` over the queries whose property is at most each threshold; null mean without any.

    Results are first summed by property value, so the thresholds meet a few sums and not rows.
    """
    sums = results.join(prop, "query").groupBy("method", F.col(column).cast("double").alias("x")).agg(F.count("f1").alias("n"), F.sum("f1").alias("s"))
    grid = sums.join(F.broadcast(thresholds.select("threshold")), F.col("x") <= F.col("threshold"), "inner")
    found = grid.groupBy("method", "threshold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    every = sums.select("method").distinct().withColumn("threshold", F.explode(F.array(*[F.lit(r.threshold) for r in thresholds.select("threshold").distinct().collect()])))
    return every.join(found, ["method", "threshold"], "left").select("method", "threshold", F.coalesce("n", F.lit(0)).alias("n"), (F.col("s") / F.col("n")).alias("mean_f1"))


def tuned(results: DataFrame, by: str = "method") -> DataFrame:
    """``by, thr, mean_f1``: the parameter with the best mean F1, the smallest of equal ones; the first of the grid if none is above 0."""
    means = results.groupBy(by, "thr").agg(F.avg("f1").alias("mean_f1"))
    place = F.struct(F.col("thr").try_cast("double").isNull().alias("text"), F.col("thr").try_cast("double").alias("x"), F.col("thr").alias("thr"))  # numbers by value, as the grids have them
    best = means.groupBy(by).agg(F.min(F.struct((-F.col("mean_f1")).alias("m"), place.alias("p"))).alias("b"), F.min(place).alias("first"))
    top = -F.col("b")["m"]
    return best.select(by, F.when(top > 0, F.col("b")["p"]["thr"]).otherwise(F.col("first")["thr"]).alias("thr"), F.greatest(top, F.lit(0.0)).alias("mean_f1"))


def macro_mean(results: DataFrame, columns: list[str], by: str = "method") -> DataFrame:
    return results.groupBy(by).agg(*[F.round(F.avg(c), 6).alias(c) for c in columns])


def target_size(truth: DataFrame, cap: int = 500, default: float = 100.0) -> DataFrame:
    """``target_size``: mean size of the ground truths, ``cap`` at most; ``default`` without any."""
    sizes = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.least(F.lit(float(cap)), F.avg("n")), F.lit(default)).alias("target_size"))
