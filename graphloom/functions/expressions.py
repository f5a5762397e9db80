"""Scalar and window expressions of the metrics and recommendation tables."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or ``empty`` where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def precision(tp, n_pred):
    return ratio(tp, n_pred)


def recall(tp, n_true):
    return ratio(tp, n_true)


def f1(tp, n_pred, n_true):
    return ratio(2.0 * tp, (n_pred + n_true).cast("double"))


def jaccard(tp, n_pred, n_true):
    return ratio(tp, n_pred + n_true - tp)


def _plogp(x, n):
    return F.when(x > 0, x / n * F.log(x / n)).otherwise(F.lit(0.0))


def nmi(tp, fp, fn, tn):
    """Normalised mutual information (arithmetic mean) of two memberships over all vertices; 1 where neither splits them, 0 where one does not."""
    n = (tp + fp + fn + tn).cast("double")
    hx = -(_plogp(tp + fp, n) + _plogp(fn + tn, n))
    hy = -(_plogp(tp + fn, n) + _plogp(fp + tn, n))
    hxy = -(_plogp(tp, n) + _plogp(fp, n) + _plogp(fn, n) + _plogp(tn, n))
    return F.when((hx == 0) & (hy == 0), F.lit(1.0)).when((hx == 0) | (hy == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 2 * (hx + hy - hxy) / (hx + hy)))


def ari(tp, fp, fn, tn):
    """Adjusted Rand index of two memberships; 1 for equal partitions."""
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    # Pairs of vertices: together in both, in one only, in neither.
    n = tp + fp + fn + tn
    same = tp * tp + fp * fp + fn * fn + tn * tn
    pred = (tp + fp) * (tp + fp) + (fn + tn) * (fn + tn)
    true = (tp + fn) * (tp + fn) + (fp + tn) * (fp + tn)
    p11, p10, p01, p00 = same - n, pred - same, true - same, n * n - pred - true + same
    return F.when((p10 == 0) & (p01 == 0), F.lit(1.0)).otherwise(2 * (p11 * p00 - p10 * p01) / ((p11 + p10) * (p10 + p00) + (p11 + p01) * (p01 + p00)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def min_max(x: Column, *by: str) -> Column:
    w = Window.partitionBy(*(by or [F.lit(0)]))
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0))


def z_score(x: Column, *by: str) -> Column:
    w = Window.partitionBy(*(by or [F.lit(0)]))
    spread = F.stddev_pop(x).over(w)
    return F.when(spread > 0, (x - F.avg(x).over(w)) / spread).otherwise(F.lit(0.0))


def share(x: Column, *by: str) -> Column:
    """x over the sum of its group; 0 where the sum is 0."""
    return ratio(x, F.sum(x).over(Window.partitionBy(*(by or [F.lit(0)]))))


def scaled(rows, columns: str | list[str], how: str = "min_max"):
    """``rows`` with ``columns`` scaled over the whole table: its statistics are aggregated first and joined as one row.

    Z-scores are taken of the columns scaled to 0..1, whose sums are those of decimals: they don't depend on the order of the rows, as sums of doubles do in
    their last digits, which tells where a score is rounded near a tie.
    """
    names = [columns] if isinstance(columns, str) else columns
    x = {c: F.col(c).cast("double") for c in names}
    low, high = {c: F.col(f"_low_{c}") for c in names}, {c: F.col(f"_high_{c}") for c in names}
    stats = rows.agg(*(f(x[c]).alias(f"{k}{c}") for c in names for k, f in (("_low_", F.min), ("_high_", F.max))))
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    joined = joined.withColumns({c: F.when(high[c] > low[c], (x[c] - low[c]) / (high[c] - low[c])).otherwise(0.0) for c in names}).drop(*stats.columns)
    if how == "min_max":
        return joined

    def mean(value, name):
        return (F.sum(value.cast("decimal(19,18)")).cast("double") / F.count(value)).alias(name)

    centre = joined.agg(*(mean(F.col(c), f"_mean_{c}") for c in names))
    off = {c: F.col(c) - F.col(f"_mean_{c}") for c in names}
    joined = joined.crossJoin(F.broadcast(centre)).withColumns(off).drop(*centre.columns)
    spread = joined.agg(*(F.sqrt(mean(F.col(c) * F.col(c), "m")).alias(f"_spread_{c}") for c in names))
    joined = joined.crossJoin(F.broadcast(spread))
    return joined.withColumns({c: F.when(F.col(f"_spread_{c}") > 0, F.col(c) / F.col(f"_spread_{c}")).otherwise(0.0) for c in names}).drop(*spread.columns)


def label_count(label: Column, n: Column) -> Column:
    """``label_count``, as column labels of tables have it."""
    return F.concat(label.cast("string"), F.lit("_"), n.cast("string"))


def query_key(nodes) -> Column:
    return F.array_join(F.transform(F.sort_array(nodes), lambda x: x.cast("string")), "_")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
