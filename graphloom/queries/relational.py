"""Edges, communities, metrics and comparisons of measured results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import analytics, metrics, prep, recommend, structure
from ..operators.search import scored
from ..plans.iterate import dealt, few, stored
from ..sources import derived as D
from ..sources.text import canonical

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(c, digits: int = 9):
    return F.round(c, digits)


@query("edge_canonicalize", "SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT l_partkey % 97 AS a, l_suppkey % 97 AS b FROM lineitem) WHERE a <> b")
def edge_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    return canonical(D.table(spark, d, "lineitem").select((F.col("l_partkey") % 97).alias("a"), (F.col("l_suppkey") % 97).alias("b")), "a", "b")


@query("degree_stats", f"WITH {D.SQL_COPART}, {D.SQL_ADJ}, g AS (SELECT s, count(*) AS deg FROM adj GROUP BY s) SELECT count(*) AS n_nodes, sum(deg)::BIGINT AS sum_degree, min(deg) AS min_degree, max(deg) AS max_degree, round(avg(deg), 9) AS mean_degree FROM g")
def degree_stats(spark, d):
    x = F.col("degree")
    return structure.degrees(D.copart(spark, d)).agg(F.count(x).alias("n_nodes"), F.sum(x).alias("sum_degree"), F.min(x).alias("min_degree"), F.max(x).alias("max_degree"), _r(F.avg(x)).alias("mean_degree"))


@query("degree_histogram", f"WITH {D.SQL_COPART}, {D.SQL_ADJ} SELECT degree, count(*) AS n_nodes FROM (SELECT s, count(*) AS degree FROM adj GROUP BY s) GROUP BY degree")
def degree_histogram(spark, d):
    return structure.degree_histogram(D.copart(spark, d))


_COUNTS = f"""{D.SQL_ADJ}, {D.SQL_BRANDS},
g AS (SELECT s, count(*) AS deg FROM adj GROUP BY s), m AS (SELECT count(*)::DOUBLE AS m FROM e),
a AS (SELECT c.community, adj.s, adj.d, c2.node IS NOT NULL AS ins FROM adj JOIN c ON adj.s = c.node LEFT JOIN c c2 ON adj.d = c2.node AND c2.community = c.community),
bd AS (SELECT DISTINCT community, s FROM a WHERE NOT ins),
z AS (SELECT c.community, count(*) AS n, coalesce(sum(deg), 0)::BIGINT AS vol FROM c LEFT JOIN g ON c.node = g.s GROUP BY 1),
y AS (SELECT a.community, (sum(CASE WHEN ins THEN 1 ELSE 0 END) / 2)::BIGINT AS inner_, sum(CASE WHEN ins THEN 0 ELSE 1 END)::BIGINT AS cut,
  (sum(CASE WHEN ins AND (x.s IS NOT NULL OR w.s IS NOT NULL) THEN 1 ELSE 0 END) / 2)::BIGINT AS bi, sum(CASE WHEN NOT ins AND x.s IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS bo
  FROM a LEFT JOIN bd x ON a.community = x.community AND a.s = x.s LEFT JOIN bd w ON a.community = w.community AND a.d = w.s GROUP BY 1),
k AS (SELECT z.community, n, vol, coalesce(inner_, 0) AS inner_, coalesce(cut, 0) AS cut, coalesce(bi, 0) AS bi, coalesce(bo, 0) AS bo FROM z LEFT JOIN y ON z.community = y.community)"""
_STATS = "SELECT community, n AS size, inner_ AS inner_edges, round(CASE WHEN n > 1 THEN 2.0::DOUBLE * inner_ / (n * (n - 1)) ELSE 0 END, 12) AS density FROM k"


@query("community_stats", f"WITH {D.SQL_COPART}, {_COUNTS} {_STATS}")
def community_stats(spark, d):
    return analytics.community_stats(D.copart(spark, d), D.brands(spark, d)).withColumn("density", _r("density", 12))


@query("community_stats_summary", f"""WITH {D.SQL_COPART}, {_COUNTS}, t AS ({_STATS}) SELECT count(*) AS n_communities, {', '.join(f"round({f}({c}::DOUBLE), 4) AS {c}_{n}" for c in ('size', 'density') for f, n in (('min', 'min'), ('max', 'max'), ('avg', 'mean'), ('median', 'median')))} FROM t""")
def community_stats_summary(spark, d):
    return analytics.stats_summary(community_stats(spark, d))


@query("community_separability", f"WITH {D.SQL_COPART}, {_COUNTS} SELECT community, round(CASE WHEN cut > 0 THEN inner_ / cut WHEN inner_ > 0 THEN 999999.0 ELSE 0 END, 9) AS separability FROM k")
def community_separability(spark, d):
    return metrics.separability(D.copart(spark, d), D.brands(spark, d)).withColumn("separability", _r("separability"))


@query("size_norm", "SELECT p_brand, maker, size, round(size / max(size) OVER (PARTITION BY maker), 9) AS size_norm FROM (SELECT p_brand, substr(p_brand, 1, 7) AS maker, count(*)::DOUBLE AS size FROM part GROUP BY 1, 2)")
def size_norm(spark, d):
    sizes = D.table(spark, d, "part").groupBy("p_brand", F.substring("p_brand", 1, 7).alias("maker")).agg(F.count(F.lit(1)).cast("double").alias("size"))
    return analytics.scaled_by_max(sizes, "size", "maker").withColumn("size_norm", _r("size_norm"))


@query("induced_subgraph", f"WITH {D.SQL_COPART} SELECT u, v FROM e WHERE u % 5 = 0 AND v % 5 = 0")
def induced_subgraph(spark, d):
    nodes = D.table(spark, d, "part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("node"))
    return structure.induced(D.copart(spark, d), nodes)


@query("boundary_nodes", f"WITH {D.SQL_COPART2}, {D.SQL_ADJ}, {D.SQL_BRANDS} SELECT c.community, c.node, EXISTS (SELECT 1 FROM adj LEFT JOIN c k ON adj.d = k.node AND k.community = c.community WHERE adj.s = c.node AND k.node IS NULL) AS boundary FROM c")
def boundary_nodes(spark, d):
    return prep.boundary_nodes(D.copart2(spark, d), D.brands(spark, d))


@query("apply_edge_delta_add", f"WITH {D.SQL_COPART2}, x AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v FROM lineitem WHERE l_partkey <> l_suppkey) SELECT u, v FROM e UNION SELECT u, v FROM x")
def apply_edge_delta_add(spark, d):
    return structure.add_edges(D.copart2(spark, d), stored(canonical(D.table(spark, d, "lineitem"), "l_partkey", "l_suppkey"), "delta"))


@query("apply_edge_delta_del", f"WITH {D.SQL_COPART2} SELECT u, v FROM e WHERE (u + v) % 3 <> 0")
def apply_edge_delta_del(spark, d):
    edges = D.copart2(spark, d)
    return structure.remove_edges(edges, edges.filter("(u + v) % 3 = 0"))


@query("two_hop", f"WITH {D.SQL_COPART2}, {D.SQL_ADJ} SELECT DISTINCT a.s, b.d FROM adj a JOIN adj b ON a.d = b.s WHERE a.s <> b.d")
def two_hop(spark, d):
    return structure.two_hop(D.copart2(spark, d))


@query("normalised_adjacency", f"WITH {D.SQL_COPART2}, {D.SQL_ADJ}, g AS (SELECT s AS node, count(*) AS k FROM adj GROUP BY s) SELECT s, d, round(1.0::DOUBLE / sqrt(x.k * y.k::DOUBLE), 12) AS w FROM adj JOIN g x ON s = x.node JOIN g y ON d = y.node")
def normalised_adjacency(spark, d):
    return structure.normalised_adjacency(D.copart2(spark, d)).withColumn("w", _r("w", 12))


@query("contract_nodes", f"WITH {D.SQL_COPART2}, t AS (SELECT CASE WHEN u % 7 = 0 THEN -1 ELSE u END AS a, CASE WHEN v % 7 = 0 THEN -1 ELSE v END AS b FROM e) SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS w FROM t WHERE a <> b GROUP BY 1, 2")
def contract_nodes(spark, d):
    edges = D.copart2(spark, d)
    nodes = D.table(spark, d, "part").filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("node"))
    return structure.contract(edges, nodes)


# Predictions: neighbours of each brand's query part over edges of weight thr or more, and their neighbours.
_PRED = f"""{D.SQL_LINES}, w AS MATERIALIZED (SELECT a.p AS u, b.p AS v, count(*) AS w FROM l a JOIN l b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2),
adj AS MATERIALIZED (SELECT t.thr, u AS s, v AS d FROM w, (VALUES (1), (2), (3)) t(thr) WHERE w.w >= t.thr UNION ALL SELECT t.thr, v, u FROM w, (VALUES (1), (2), (3)) t(thr) WHERE w.w >= t.thr),
q AS (SELECT min(p_partkey) AS node FROM part GROUP BY p_brand),
p AS MATERIALIZED (SELECT 'hop1' AS method, thr, q.node AS query, d AS node FROM q JOIN adj ON s = q.node UNION SELECT 'hop1', t.thr, node, node FROM q, (VALUES (1), (2), (3)) t(thr)
  UNION SELECT 'hop2', a.thr, q.node, b.d FROM q JOIN adj a ON a.s = q.node JOIN adj b ON a.d = b.s AND a.thr = b.thr WHERE a.thr > 1
  UNION SELECT 'hop2', thr, q.node, d FROM q JOIN adj ON s = q.node WHERE thr > 1 UNION SELECT 'hop2', t.thr, node, node FROM q, (VALUES (2), (3)) t(thr)),
gt AS (SELECT q.node AS query, y.p_partkey AS node FROM q JOIN part x ON q.node = x.p_partkey JOIN part y ON x.p_brand = y.p_brand),
nt AS (SELECT query, count(*) AS nt FROM gt GROUP BY query),
o AS (SELECT p.method, p.thr, p.query, count(gt.node) AS tp, count(*) AS np FROM p LEFT JOIN gt ON p.query = gt.query AND p.node = gt.node GROUP BY ALL),
r AS MATERIALIZED (SELECT query::VARCHAR AS query, method, thr::VARCHAR AS thr, CASE WHEN np + nt > 0 THEN 2.0::DOUBLE * tp / (np + nt) ELSE 0 END AS f1, np::DOUBLE AS time FROM o JOIN nt USING (query))"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """``method, thr, query_id, node``. Queries and what they reach are few beside the edges, so they go to the edges; Spark's guess of their size grows with the table they come from, and beyond its bound all edges would be shuffled and sorted."""
    weighted = stored(D.copart_weighted(spark, d), "weighted")
    asked = stored(D.brand_queries(spark, d), "asked")
    n, out = asked.count(), None
    for thr in (1, 2, 3):
        edges = weighted.filter(F.col("w") >= thr).select("u", "v")
        adj = structure.adjacency(edges).withColumnRenamed("s", "node")
        one = stored(few(asked, n).join(adj, "node").select("query_id", F.col("d").alias("node")).unionByName(asked).distinct(), "one")
        found = [("hop1", one)]
        if thr > 1:
            two = few(one, one.count()).join(adj, "node").select("query_id", F.col("d").alias("node")).unionByName(one).distinct()
            found.append(("hop2", two))
        for method, rows in found:
            rows = rows.select(F.lit(method).alias("method"), F.lit(str(thr)).alias("thr"), "query_id", "node")
            out = rows if out is None else out.unionByName(rows)
    return out


def truth(spark: SparkSession, d: str) -> DataFrame:
    part = D.table(spark, d, "part")
    q = part.groupBy("p_brand").agg(F.min("p_partkey").alias("query_id"))
    return part.join(few(q, q.count()), "p_brand").select("query_id", F.col("p_partkey").alias("node"))


def measured(spark: SparkSession, d: str) -> DataFrame:
    gt = truth(spark, d)
    pred = predictions(spark, d)
    true = dealt(gt.withColumn("t", F.lit(1)), D.table(spark, d, "part").count(), "query_id", "node")
    nt = gt.groupBy("query_id").agg(F.count(F.lit(1)).alias("nt"))
    hit = pred.join(true, ["query_id", "node"], "left").groupBy("method", "thr", "query_id").agg(F.sum(F.coalesce("t", F.lit(0))).alias("tp"), F.count(F.lit(1)).alias("np"))
    out = hit.join(nt, "query_id").select(F.col("query_id").cast("string").alias("query"), "method", "thr", X.f1(F.col("tp"), F.col("np"), F.col("nt")).alias("f1"), F.col("np").cast("double").alias("time"))
    return stored(out, "measured")


@query("gt_metrics", f"""WITH {_PRED}, n AS (SELECT count(*)::DOUBLE AS n FROM part),
x AS (SELECT query::BIGINT AS query_id, tp::DOUBLE AS tp, (np - tp)::DOUBLE AS fp, (nt - tp)::DOUBLE AS fn, n - np - nt + tp AS tn, n, np, nt FROM o JOIN nt USING (query), n WHERE method = 'hop1' AND thr = 2),
h AS (SELECT *, -(list_sum(list_transform([tp + fp, fn + tn], lambda v: CASE WHEN v > 0 THEN v / n * ln(v / n) ELSE 0 END))) AS hx, -(list_sum(list_transform([tp + fn, fp + tn], lambda v: CASE WHEN v > 0 THEN v / n * ln(v / n) ELSE 0 END))) AS hy,
  -(list_sum(list_transform([tp, fp, fn, tn], lambda v: CASE WHEN v > 0 THEN v / n * ln(v / n) ELSE 0 END))) AS hxy,
  tp * (tp - 1) / 2 + fp * (fp - 1) / 2 + fn * (fn - 1) / 2 + tn * (tn - 1) / 2 AS ij, (tp + fp) * (tp + fp - 1) / 2 + (fn + tn) * (fn + tn - 1) / 2 AS ai, (tp + fn) * (tp + fn - 1) / 2 + (fp + tn) * (fp + tn - 1) / 2 AS bj, n * (n - 1) / 2 AS al FROM x)
SELECT query_id, round(CASE WHEN np > 0 THEN tp / np ELSE 0 END, 9) AS pre, round(CASE WHEN nt > 0 THEN tp / nt ELSE 0 END, 9) AS rec, round(2 * tp / (np + nt), 9) AS f1, round(tp / (np + nt - tp), 9) AS jac,
  round(CASE WHEN hx = 0 AND hy = 0 THEN 1.0 WHEN hx = 0 OR hy = 0 THEN 0 ELSE greatest(0, 2 * (hx + hy - hxy) / (hx + hy)) END, 9) AS nmi,
  round(CASE WHEN ij = ai AND ij = bj THEN 1.0 ELSE (ij - ai * bj / al) / ((ai + bj) / 2 - ai * bj / al) END, 9) AS ari FROM h""")
def gt_metrics(spark, d):
    pred = predictions(spark, d).filter("method = 'hop1' and thr = '2'")
    n = D.table(spark, d, "part").count()
    out = metrics.truth_metrics(pred, truth(spark, d), n)
    return out.select("query_id", *[_r(c).alias(c) for c in ("pre", "rec", "f1", "jac", "nmi", "ari")])


@query("structural_metrics", f"""WITH {D.SQL_COPART2}, {_COUNTS} SELECT community, round(2.0::DOUBLE * inner_ / n, 9) AS avg_degree, round(CASE WHEN n > 1 THEN 2.0::DOUBLE * inner_ / (n * (n - 1)) ELSE 0 END, 9) AS density, n AS size,
round(CASE WHEN least(vol, 2 * m - vol) > 0 THEN cut / least(vol, 2 * m - vol) ELSE 0 END, 9) AS conductance, round(inner_ / m - (vol / (2 * m)) ** 2, 9) AS modularity, round(inner_ / n - vol::DOUBLE * vol / (4 * m * n), 9) AS density_modularity,
round(CASE WHEN bi + bo > 0 THEN bi / (bi + bo) ELSE 0 END, 9) AS local_modularity, round(CASE WHEN cut > 0 THEN inner_ / cut ELSE 0 END, 9) AS subgraph_modularity, round(inner_ - n * (n - 1) / 6, 9) AS edge_surplus FROM k, m""")
def structural_metrics(spark, d):
    out = metrics.structural_metrics(D.copart2(spark, d), D.brands(spark, d))
    return out.select("community", "size", *[_r(c).alias(c) for c in out.columns if c not in ("community", "size")])


@query("best_matches", f"""WITH {_PRED}, a AS (SELECT query::VARCHAR AS p, node FROM p WHERE method = 'hop1' AND thr = 1), b AS (SELECT p_brand AS t, p_partkey AS node FROM part),
na AS (SELECT p, count(*) AS np FROM a GROUP BY p), nb AS (SELECT t, count(*) AS nt FROM b GROUP BY t), x AS (SELECT p, t, count(*) AS tp FROM a JOIN b USING (node) GROUP BY ALL),
s AS (SELECT p, t, 2.0::DOUBLE * tp / (np + nt) AS f1, tp::DOUBLE / (np + nt - tp) AS jac FROM x JOIN na USING (p) JOIN nb USING (t)),
m AS (SELECT avg(coalesce(f1, 0)) AS f1, avg(coalesce(jac, 0)) AS jac FROM na LEFT JOIN (SELECT p, max(f1) AS f1, max(jac) AS jac FROM s GROUP BY p) USING (p) UNION ALL SELECT avg(coalesce(f1, 0)), avg(coalesce(jac, 0)) FROM nb LEFT JOIN (SELECT t, max(f1) AS f1, max(jac) AS jac FROM s GROUP BY t) USING (t))
SELECT round(avg(f1), 9) AS f1, round(avg(jac), 9) AS jac FROM m""")
def best_matches(spark, d):
    pred = predictions(spark, d).filter("method = 'hop1' and thr = '1'").select(F.col("query_id").cast("string").alias("community"), "node")
    return metrics.best_matches(pred, D.brands(spark, d)).select(_r("f1").alias("f1"), _r("jac").alias("jac"))


_NAMED = "b AS (SELECT query, method || '/' || thr AS method, f1, time FROM r)"


def _named(spark, d):
    return measured(spark, d).select("query", F.concat_ws("/", "method", "thr").alias("method"), "f1", "time")


@query("best_method_counts", f"WITH {_PRED}, {_NAMED}, t AS (SELECT method, count(*) AS n FROM (SELECT *, max(f1) OVER (PARTITION BY query) AS top FROM b) WHERE f1 = top GROUP BY method), a AS (SELECT DISTINCT method FROM b) SELECT method, coalesce(n, 0) AS n_best, round(100.0::DOUBLE * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 3) AS pct FROM a LEFT JOIN t USING (method)")
def best_method_counts(spark, d):
    return analytics.best_methods(_named(spark, d))


@query("best_method_exclusive", f"WITH {_PRED}, {_NAMED}, t AS (SELECT method, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY query) AS k FROM (SELECT *, max(f1) OVER (PARTITION BY query) AS top FROM b) WHERE f1 = top) WHERE k = 1 GROUP BY method), a AS (SELECT DISTINCT method FROM b) SELECT method, coalesce(n, 0) AS n_best, round(CASE WHEN sum(coalesce(n, 0)) OVER () > 0 THEN 100.0::DOUBLE * coalesce(n, 0) / sum(coalesce(n, 0)) OVER () ELSE 0 END, 3) AS pct FROM a LEFT JOIN t USING (method)")
def best_method_exclusive(spark, d):
    return analytics.best_methods(_named(spark, d), exclusive=True)


_RANKS = "v AS (SELECT DISTINCT nt::DOUBLE AS x FROM nt), k AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM v), g AS (SELECT q, x AS threshold FROM k, (VALUES (0.2), (0.4), (0.6), (0.8), (1.0)) t(q) WHERE n > 5 AND i = CASE WHEN q = 1.0 THEN n - 1 ELSE greatest(0, floor(n * q::DOUBLE) - 1) END UNION ALL SELECT (i + 1) / n, x FROM k WHERE n <= 5)"


@query("rank_quantiles", f"WITH {_PRED}, {_RANKS} SELECT q::DOUBLE AS q, threshold FROM g")
def rank_quantiles(spark, d):
    sizes = truth(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    return analytics.rank_quantiles(sizes, "size")


@query("gt_property_cumulative", f"WITH {_PRED}, {_NAMED}, {_RANKS} SELECT method, threshold, count(*) AS n, round(avg(f1), 9) AS mean_f1 FROM b JOIN nt ON b.query = nt.query::VARCHAR JOIN g ON nt.nt <= threshold GROUP BY ALL")
def gt_property_cumulative(spark, d):
    sizes = truth(spark, d).groupBy(F.col("query_id").cast("string").alias("query")).agg(F.count(F.lit(1)).alias("size"))
    out = analytics.cumulative_by_property(_named(spark, d), sizes, "size", analytics.rank_quantiles(sizes, "size"))
    return out.withColumn("mean_f1", _r("mean_f1"))


@query("tune_threshold", f"WITH {_PRED}, t AS (SELECT method, thr, avg(f1) AS f FROM r GROUP BY ALL) SELECT method, arg_min(thr, (-round(f, 12), thr)) AS thr, round(max(f), 9) AS mean_f1 FROM t GROUP BY method")
def tune_threshold(spark, d):
    return analytics.tuned(measured(spark, d)).withColumn("mean_f1", _r("mean_f1"))


@query("macro_means", f"WITH {_PRED} SELECT method, round(avg(f1), 6) AS f1, round(avg(time), 6) AS time FROM r GROUP BY method")
def macro_means(spark, d):
    return analytics.macro_mean(measured(spark, d), ["f1", "time"])


@query("target_size", "SELECT least(500.0, avg(n))::DOUBLE AS target_size FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)")
def target_size(spark, d):
    return analytics.target_size(truth(spark, d))


@query("soft_labels", f"WITH {_PRED}, t AS (SELECT query, method, max(f1) AS f1 FROM r GROUP BY ALL) SELECT query, method, round(f1, 9) AS f1, round(exp(f1 / 0.2::DOUBLE) / (sum(exp(f1 / 0.2::DOUBLE)) OVER (PARTITION BY query) + 1e-10), 9) AS label FROM t")
def soft_labels(spark, d):
    return recommend.soft_labels(measured(spark, d)).select("query", "method", _r("f1").alias("f1"), _r("label").alias("label"))


@query("param_targets", f"WITH {_PRED}, t AS (SELECT query, method, thr, avg(f1) AS f1 FROM r GROUP BY ALL), s AS (SELECT *, sum(f1) OVER (PARTITION BY query, method) AS z FROM t) SELECT query, method, thr, round(f1, 9) AS f1, round(CASE WHEN z > 0 THEN f1 / z ELSE 0 END, 9) AS target, CASE WHEN z > 0 THEN 1 ELSE 0 END AS mask FROM s")
def param_targets(spark, d):
    return recommend.parameter_targets(measured(spark, d)).select("query", "method", "thr", _r("f1").alias("f1"), _r("target").alias("target"), "mask")


_PROB = "pr AS (SELECT query, method || '/' || thr AS method, round(f1, 6) AS p FROM r)"


@query("topk_recommend", f"WITH {_PRED}, {_PROB} SELECT query, method, rank FROM (SELECT query, method, row_number() OVER (PARTITION BY query ORDER BY p DESC, method)::INT AS rank FROM pr) WHERE rank <= 3")
def topk_recommend(spark, d):
    return recommend.top_methods(_named(spark, d).select("query", "method", F.round("f1", 6).alias("p")), 3)


@query("recommend_lookup", f"WITH {_PRED}, k AS (SELECT query, method, thr, row_number() OVER (PARTITION BY query ORDER BY method, thr) AS rank, f1, time FROM r), t AS (SELECT * FROM k WHERE rank <= 3) SELECT query, round(max(f1), 9) AS f1, arg_min(thr, (-round(f1, 12), rank)) AS thr, arg_min(method, (-round(f1, 12), rank)) AS method, sum(time) AS time, count(*) AS n_found FROM t GROUP BY query")
def recommend_lookup(spark, d):
    from pyspark.sql import Window

    rows = measured(spark, d)
    order = F.row_number().over(Window.partitionBy("query").orderBy("method", "thr"))
    chosen = rows.withColumn("rank", order).filter("rank <= 3").select("query", "method", "thr", "rank")
    return recommend.looked_up(chosen, rows).withColumn("f1", _r("f1"))


@query("parameter_grid", """SELECT method, bin::INT AS bin, (a + bin * s)::VARCHAR AS thr FROM (SELECT method, a, s, unnest(range(n)) AS bin FROM (VALUES ('ktruss', 3, 1, 18), ('kclique', 1, 1, 7), ('ICS_GNN', 10, 10, 40)) t(method, a, s, n))
UNION ALL SELECT method, bin::INT, rtrim(rtrim(printf('%.2f', bin * 0.05::DOUBLE), '0'), '.') FROM (SELECT unnest(['COCLEP', 'QD_GNN']) AS method, bin FROM range(20) t(bin))
UNION ALL SELECT 'CommunityAF', bin::INT, (bin // 5 + 1) || '_' || (bin % 5 + 1) FROM range(50) t(bin)""")
def parameter_grid(spark, d):
    return recommend.parameter_grid(spark)


@query("scored_prefix", "WITH s AS (SELECT p_brand AS b, p_partkey AS node, round(p_retailprice, 4) AS score FROM part), w AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, node) AS r, sum(score) OVER (PARTITION BY b ORDER BY score DESC, node ROWS UNBOUNDED PRECEDING) AS s, avg(score) OVER (PARTITION BY b) AS mean, count(*) OVER (PARTITION BY b) AS n FROM s), g AS (SELECT *, CASE WHEN r <= greatest(1, least(10000, floor(n / 2))) THEN round((s - r * mean) / sqrt(r), 6) END AS gain FROM w), t AS (SELECT *, max(gain) OVER (PARTITION BY b) AS top FROM g), c AS (SELECT *, min(CASE WHEN gain = top THEN r END) OVER (PARTITION BY b) AS cut FROM t) SELECT b AS query_id, node FROM c WHERE r <= cut")
def scored_prefix(spark, d):
    return scored.best_prefix(D.table(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("node"), F.round("p_retailprice", 4).alias("score")))


@query("row_normalised", "SELECT vec_id AS node, j, round(abs(x) / sum(abs(x)) OVER (PARTITION BY vec_id), 9) AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)")
def row_normalised(spark, d):
    rows = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.posexplode("embedding").alias("j", "x"))
    return prep.row_normalised(rows.select("node", F.col("j").cast("long").alias("j"), F.abs(F.col("x").cast("double")).alias("x"))).withColumn("x", _r("x"))


@query("streaming_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def streaming_windows(spark, d):
    from ..streaming.degrees import windowed_activity

    return windowed_activity(D.table(spark, d, "events")).withColumn("total", F.round("total", 6))
