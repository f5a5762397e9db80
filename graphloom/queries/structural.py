"""Triangles, cores, trusses, components, distances, cliques, diffusion, and the searches built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep, recommend, structure
from ..operators.search import METHODS, local, scored, search
from ..plans.iterate import stored
from ..sources import derived as D

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


_TRI = "t AS MATERIALIZED (SELECT a.u AS x, a.v AS y, b.v AS z FROM e a JOIN e b ON a.v = b.u JOIN e c ON c.u = a.u AND c.v = b.v)"
_E7, _E2, _A = D.SQL_COPART7, D.SQL_COPART2, D.SQL_ADJ
_DEG = "g AS (SELECT s AS node, count(*) AS degree FROM adj GROUP BY s)"


@query("triangle_count", f"WITH {_E7}, {_TRI} SELECT count(*) AS n_triangles FROM t")
def triangle_count(spark, d):
    return structure.triangles(D.copart7(spark, d)).agg(F.count(F.lit(1)).alias("n_triangles"))


@query("edge_support", f"WITH {_E7}, {_TRI}, s AS (SELECT x AS u, y AS v FROM t UNION ALL SELECT x, z FROM t UNION ALL SELECT y, z FROM t), c AS (SELECT u, v, count(*) AS support FROM s GROUP BY ALL) SELECT e.u, e.v, coalesce(support, 0) AS support FROM e LEFT JOIN c USING (u, v)")
def edge_support(spark, d):
    return structure.edge_support(D.copart7(spark, d))


@query("clustering_coefficient", f"WITH {_E7}, {_A}, {_TRI}, {_DEG}, c AS (SELECT node, count(*) AS k FROM (SELECT unnest([x, y, z]) AS node FROM t) GROUP BY node) SELECT g.node, degree, coalesce(k, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(k, 0) / (degree * (degree - 1)) ELSE 0 END, 9) AS cc FROM g LEFT JOIN c ON g.node = c.node")
def clustering_coefficient(spark, d):
    return structure.clustering(D.copart7(spark, d)).withColumn("cc", _r("cc"))


@query("local_degree_profile", f"WITH {_E7}, {_A}, {_DEG} SELECT s AS node, count(*) AS degree, min(degree) AS nbr_min, max(degree) AS nbr_max, round(avg(degree), 9) AS nbr_mean, round(stddev_pop(degree), 9) AS nbr_std FROM adj JOIN g ON d = g.node GROUP BY s")
def local_degree_profile(spark, d):
    return structure.degree_profile(D.copart7(spark, d)).withColumns({"nbr_mean": _r("nbr_mean"), "nbr_std": _r("nbr_std")})


def _h(i: int, before: str) -> str:
    return f"h{i} AS MATERIALIZED (SELECT node, max(least(value, rk)) AS value FROM (SELECT s AS node, value, row_number() OVER (PARTITION BY s ORDER BY value DESC) AS rk FROM adj JOIN {before} ON d = {before}.node) GROUP BY node)"


def _cores(rounds: int) -> str:
    """Rounds of h-indices, unrolled: enough for the derived graphs at the sizes that the SQL is run on (a fixpoint beyond would differ from the operator's)."""
    parts = ["h0 AS MATERIALIZED (SELECT s AS node, count(*) AS value FROM adj GROUP BY s)"] + [_h(i, f"h{i - 1}") for i in range(1, rounds + 1)]
    return ", ".join(parts) + f", core AS (SELECT node, value AS core FROM h{rounds})"


CORE_ROUNDS = 40
_CORES_40, _H1 = _cores(CORE_ROUNDS), "h0 AS MATERIALIZED (SELECT s AS node, count(*) AS value FROM adj GROUP BY s), " + _h(1, "h0")


@query("hindex_orders", f"WITH {_E7}, {_A}, h0 AS (SELECT s AS node, count(*) AS value FROM adj GROUP BY s), {_h(1, 'h0')}, {_h(2, 'h1')}, {_h(3, 'h2')} SELECT h0.node, h0.value AS h0, h1.value AS h1, h2.value AS h2, h3.value AS h3 FROM h0 JOIN h1 USING (node) JOIN h2 USING (node) JOIN h3 USING (node)")
def hindex_orders(spark, d):
    return structure.h_index_orders(D.copart7(spark, d))


@query("core_number", f"WITH {_E7}, {_A}, {_cores(CORE_ROUNDS)} SELECT node, core FROM core")
def core_number(spark, d):
    return structure.core_numbers(D.copart7(spark, d))


@query("structural_features", f"WITH {_E2}, {_A}, {_cores(16)}, v AS (SELECT p_partkey AS node, coalesce(core, 0) AS core FROM part LEFT JOIN core ON p_partkey = node) SELECT node, core, round((core - min(core) OVER ()) / (max(core) OVER () - min(core) OVER ()), 9) AS feat FROM v")
def structural_features(spark, d):
    vertices = D.table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return prep.structural_features(D.copart2(spark, d), vertices).withColumn("feat", _r("feat"))


def _truss(rounds: int) -> str:
    key = lambda a, b: f"{a} || '-' || {b}"
    xy, xz, yz = key("x", "y"), key("x", "z"), key("y", "z")
    parts = [f"tt AS MATERIALIZED (SELECT {xy} AS k, {xz} AS f, {yz} AS g FROM t UNION ALL SELECT {xz}, {xy}, {yz} FROM t UNION ALL SELECT {yz}, {xy}, {xz} FROM t)", "r0 AS MATERIALIZED (SELECT k, count(*) AS value FROM tt GROUP BY k)"]
    for i in range(1, rounds + 1):
        b = f"r{i - 1}"
        parts.append(f"r{i} AS MATERIALIZED (SELECT k, max(least(value, rk)) AS value FROM (SELECT tt.k, least(p.value, q.value) AS value, row_number() OVER (PARTITION BY tt.k ORDER BY least(p.value, q.value) DESC) AS rk FROM tt JOIN {b} p ON tt.f = p.k JOIN {b} q ON tt.g = q.k) GROUP BY k)")
    return ", ".join(parts) + f", truss AS (SELECT u, v, coalesce(value, 0) + 2 AS truss FROM e LEFT JOIN r{rounds} ON k = u || '-' || v)"


TRUSS_ROUNDS = 24


@query("truss_number", f"WITH {_E7}, {_TRI}, {_truss(TRUSS_ROUNDS)} SELECT u, v, truss FROM truss")
def truss_number(spark, d):
    return structure.truss_numbers(D.copart7(spark, d))


_REACH = "reach AS (SELECT s AS node, s AS label FROM adj UNION SELECT adj.d, reach.label FROM reach JOIN adj ON reach.node = adj.s WHERE reach.label < adj.d)"


@query("connected_components", f"WITH RECURSIVE {_E2}, {_A}, {_REACH} SELECT node, min(label) AS component FROM reach GROUP BY node")
def connected_components(spark, d):
    return structure.components(D.copart2(spark, d))


_FROM = "src AS (SELECT min(s) AS node FROM adj)"


@query("bfs_levels", f"WITH RECURSIVE {_E2}, {_A}, {_FROM}, r AS (SELECT node, 0 AS dist FROM src UNION SELECT adj.d, dist + 1 FROM r JOIN adj ON r.node = adj.s WHERE dist < 40) SELECT node, min(dist)::INT AS dist FROM r GROUP BY node")
def bfs_levels(spark, d):
    edges = D.copart2(spark, d)
    source = edges.agg(F.min(F.least("u", "v")).alias("node"))
    return structure.bfs(edges, source).select("node", "dist")


@query("ego_nets", f"WITH RECURSIVE {_E2}, {_A}, {D.SQL_QUERIES}, r AS (SELECT node AS q, node, 0 AS dist FROM q UNION SELECT r.q, adj.d, dist + 1 FROM r JOIN adj ON r.node = adj.s WHERE dist < 14), m AS (SELECT q, node, min(dist) AS dist FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, node) AS i FROM m) SELECT q AS query_id, node, dist::INT AS dist FROM k WHERE i <= 20")
def ego_nets(spark, d):
    return structure.ego_nets(D.copart2(spark, d), D.brand_queries(spark, d), 20)


@query("kcore_search", f"""WITH RECURSIVE {_E7}, {_A}, {_cores(CORE_ROUNDS)}, {D.SQL_QUERIES}, kq AS (SELECT q.node AS q, core AS k FROM q JOIN core USING (node)),
r AS (SELECT q, k, q AS node FROM kq UNION SELECT r.q, r.k, adj.d FROM r JOIN adj ON r.node = adj.s JOIN core ON adj.d = core.node WHERE core.core >= r.k) SELECT q AS query_id, node FROM r""")
def kcore_search(spark, d):
    return search("kcore", D.copart7(spark, d), D.brand_queries(spark, d))


@query("csformer_search", f"""WITH {_E7}, {_A}, {_cores(CORE_ROUNDS)}, {D.SQL_QUERIES}, kq AS (SELECT q.node AS q, core AS k FROM q JOIN core USING (node)),
n AS (SELECT q, q AS node FROM kq UNION SELECT q, d FROM kq JOIN adj ON s = q UNION SELECT q, b.d FROM kq JOIN adj a ON a.s = q JOIN adj b ON a.d = b.s) SELECT n.q AS query_id, n.node FROM n JOIN kq USING (q) JOIN core ON core.node = n.node WHERE core >= k""")
def csformer_search(spark, d):
    return search("csformer", D.copart7(spark, d), D.brand_queries(spark, d))


_TRUSS_LINKS = f"""{_truss(TRUSS_ROUNDS)}, s AS MATERIALIZED (SELECT u, v FROM truss WHERE truss >= 8), st AS MATERIALIZED (SELECT x, y, z FROM t WHERE (x, y) IN (SELECT (u, v) FROM s) AND (x, z) IN (SELECT (u, v) FROM s) AND (y, z) IN (SELECT (u, v) FROM s)),
ln AS MATERIALIZED (SELECT x || '-' || y AS a, unnest([x || '-' || z, y || '-' || z]) AS b FROM st), lk AS MATERIALIZED (SELECT a, b FROM ln UNION SELECT b, a FROM ln)"""


@query("ktruss_search", f"""WITH RECURSIVE {_E7}, {_TRI}, {_TRUSS_LINKS}, {D.SQL_QUERIES},
r AS (SELECT q.node AS q, u || '-' || v AS k FROM q JOIN s ON q.node = u OR q.node = v UNION SELECT r.q, lk.b FROM r JOIN lk ON r.k = lk.a),
f AS (SELECT DISTINCT q, unnest([split_part(k, '-', 1), split_part(k, '-', 2)])::BIGINT AS node FROM r) SELECT q AS query_id, node FROM f UNION SELECT node, node FROM q WHERE node NOT IN (SELECT q FROM f)""")
def ktruss_search(spark, d):
    return search("ktruss", D.copart7(spark, d), D.brand_queries(spark, d), k=8)


@query("kecc_search")
def kecc_search(spark, d):
    return search("kecc", D.copart2(spark, d), D.brand_queries(spark, d))


@query("spanning_forest", None)
def spanning_forest(spark, d):
    edges = stored(D.copart_weighted(spark, d).filter("w >= 2"), "weighted")
    return structure.spanning_forest(edges)


def _rank(rounds: int, home: str, step: str) -> str:
    parts = [f"k0 AS MATERIALIZED (SELECT g.node, {home} AS home, {home} AS rank FROM g)"]
    for i in range(1, rounds + 1):
        parts.append(f"k{i} AS MATERIALIZED (SELECT k.node, k.home, {step.format(b=f'k{i - 1}')} AS rank FROM k0 k)")
    return ", ".join(parts)


_PR = "0.85::DOUBLE * coalesce((SELECT sum(b.rank / g2.degree) FROM adj JOIN {b} b ON adj.s = b.node JOIN g g2 ON g2.node = adj.s WHERE adj.d = k.node), 0) + 0.15::DOUBLE * k.home"


@query("pagerank_10", f"WITH {_E2}, {_A}, {_DEG}, {_rank(10, '(1.0::DOUBLE / (SELECT count(*) FROM g))', _PR)} SELECT node, round(rank, 9) AS rank FROM k10")
def pagerank_10(spark, d):
    return structure.pagerank(D.copart2(spark, d)).withColumn("rank", _r("rank"))


@query("ppr_10", f"WITH {_E2}, {_A}, {_DEG}, {_rank(10, 'CASE WHEN g.node = (SELECT min(node) FROM g) THEN 1.0::DOUBLE ELSE 0 END', _PR)} SELECT node, round(rank, 9) AS rank FROM k10")
def ppr_10(spark, d):
    edges = D.copart2(spark, d)
    return structure.pagerank(edges, edges.agg(F.min("u").alias("node"))).withColumn("rank", _r("rank"))


_PX = "CASE WHEN k.home = 1 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE * (SELECT sum(b.rank) / count(*) FROM adj JOIN {b} b ON adj.d = b.node WHERE adj.s = k.node) END"


@query("proximity_10", f"WITH {_E2}, {_A}, {_DEG}, {_rank(10, 'CASE WHEN g.node = (SELECT min(node) FROM g) THEN 1.0::DOUBLE ELSE 0 END', _PX)} SELECT node, round(rank, 9) AS rank FROM k10")
def proximity_10(spark, d):
    edges = D.copart2(spark, d)
    return structure.proximity(edges, edges.agg(F.min("u").alias("node"))).withColumn("rank", _r("rank"))


@query("feature_propagation_2", f"WITH {_E2}, {_A}, {_DEG}, w AS (SELECT s, d, 1.0::DOUBLE / sqrt(a.degree * b.degree::DOUBLE) AS w FROM adj JOIN g a ON s = a.node JOIN g b ON d = b.node), x0 AS (SELECT p_partkey AS node, 0 AS hop, 0 AS j, p_size::DOUBLE AS x FROM part), x1 AS (SELECT s AS node, 1 AS hop, j, sum(w * x) AS x FROM w JOIN x0 ON d = x0.node GROUP BY ALL), x2 AS (SELECT s AS node, 2 AS hop, j, sum(w * x) AS x FROM w JOIN x1 ON d = x1.node GROUP BY ALL) SELECT node, hop, j, round(x, 9) AS x FROM (FROM x0 UNION ALL FROM x1 UNION ALL FROM x2)")
def feature_propagation_2(spark, d):
    features = D.table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.lit(0).alias("j"), F.col("p_size").cast("double").alias("x"))
    return structure.propagate(D.copart2(spark, d), features, 2).withColumn("x", _r("x"))


@query("sweep_cut", f"WITH {_E2}, {_A}, {_DEG}, {_rank(10, 'CASE WHEN g.node = (SELECT min(node) FROM g) THEN 1.0::DOUBLE ELSE 0 END', _PR)}, o AS (SELECT k10.node, degree, row_number() OVER (ORDER BY round(round(rank, 9) / degree, 12) DESC, k10.node) AS pos FROM k10 JOIN g ON k10.node = g.node WHERE round(rank, 9) > 0), i AS (SELECT greatest(a.pos, b.pos) AS pos, count(*) AS n FROM e JOIN o a ON u = a.node JOIN o b ON v = b.node GROUP BY 1), c AS (SELECT node, o.pos, sum(degree) OVER (ORDER BY o.pos)::BIGINT AS vol, sum(coalesce(n, 0)) OVER (ORDER BY o.pos)::BIGINT AS ins FROM o LEFT JOIN i ON o.pos = i.pos), m AS (SELECT 2 * count(*) AS m2 FROM e) SELECT node, pos, vol, vol - 2 * ins AS cut, round(CASE WHEN least(vol, m2 - vol) > 0 THEN (vol - 2 * ins) / least(vol, m2 - vol) ELSE 0 END, 9) AS conductance FROM c, m")
def sweep_cut(spark, d):
    edges = D.copart2(spark, d)
    ranks = structure.pagerank(edges, edges.agg(F.min("u").alias("node"))).withColumn("rank", _r("rank")).filter("rank > 0")
    return scored.sweep_cut(edges, ranks).withColumn("conductance", _r("conductance"))


_SCORES = "sc AS (SELECT q.node AS q, p_partkey AS node, ((p_partkey * 7919 + q.node * 104729) % 1000) / 1000.0::DOUBLE AS score FROM q, part)"


def scores(spark, d):
    """Stand-ins for a model's scores: a fixed number for each query and vertex."""
    queries = D.brand_queries(spark, d).select("query_id")
    part = D.table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    every = part.withColumn("query_id", F.explode(F.array(*[F.lit(r.query_id) for r in queries.collect()])))
    return every.select("query_id", "node", (F.pmod(F.col("node") * 7919 + F.col("query_id") * 104729, F.lit(1000)) / 1000.0).alias("score"))


@query("threshold_bfs", f"WITH RECURSIVE {_E2}, {_A}, {D.SQL_QUERIES}, {_SCORES}, r AS (SELECT node AS q, node FROM q UNION SELECT r.q, adj.d FROM r JOIN adj ON r.node = adj.s JOIN sc ON sc.q = r.q AND sc.node = adj.d WHERE score >= 0.5) SELECT q AS query_id, node FROM r")
def threshold_bfs(spark, d):
    return scored.threshold_bfs(D.copart2(spark, d), D.brand_queries(spark, d), scores(spark, d), 0.5)


@query("prefix_component")
def prefix_component(spark, d):
    return scored.prefix_component(D.copart2(spark, d), D.brand_queries(spark, d), scores(spark, d))


@query("cluster_expand", f"WITH RECURSIVE {_E2}, {_A}, {D.SQL_QUERIES}, {_SCORES}, g AS MATERIALIZED (SELECT q, node, p_brand AS cluster FROM sc JOIN part ON node = p_partkey WHERE score >= 0.9), r AS (SELECT node AS q, p_brand AS cluster FROM q JOIN part ON node = p_partkey UNION SELECT r.q, g.cluster FROM r JOIN part ON p_brand = r.cluster JOIN adj ON adj.s = p_partkey JOIN g ON g.q = r.q AND g.node = adj.d) SELECT q AS query_id, node FROM g JOIN r USING (q, cluster) UNION SELECT node, node FROM q")
def cluster_expand(spark, d):
    clusters = D.table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster"))
    return scored.cluster_expand(D.copart2(spark, d), D.brand_queries(spark, d), scores(spark, d), clusters, 0.9)


@query("heap_growth")
def heap_growth(spark, d):
    return scored.heap_growth(D.copart2(spark, d), D.brand_queries(spark, d), scores(spark, d), top=20)


@query("mean_growth")
def mean_growth(spark, d):
    return scored.heap_growth(D.copart2(spark, d), D.brand_queries(spark, d), scores(spark, d), mean=True)


@query("swap_growth")
def swap_growth(spark, d):
    return scored.swap_growth(D.copart2(spark, d), D.brand_queries(spark, d), scores(spark, d), top=15)


def _search(name: str, method: str, **parameters) -> None:
    @query(name)
    def run(spark, d):
        return search(method, D.copart2(spark, d), D.brand_queries(spark, d), **parameters)


_search("lm_search", "lm")
_search("sgm_search", "sgm")
_search("dmcs_search", "dmcs")
_search("ppr_nibble", "ppr")


@query("qdc_search")
def qdc_search(spark, d):
    return search("qdc", D.copart2(spark, d), D.brand_queries(spark, d))


@query("ego_features")
def ego_features(spark, d):
    return recommend.ego_features(D.copart2(spark, d), D.brand_queries(spark, d), 100).withColumn("log_ppr_z", _r("log_ppr_z", 6))


# Brands share no parts, so that every connected part of three vertices or more is a community of its own.
@query("community_repair", f"""WITH RECURSIVE {D.SQL_COPART}, {D.SQL_ADJ}, {D.SQL_BRANDS}, near AS MATERIALIZED (SELECT x.community, adj.s, adj.d FROM adj JOIN c x ON x.node = adj.s JOIN c y ON y.node = adj.d AND x.community = y.community),
reach AS (SELECT node, node AS root FROM c UNION SELECT near.d, reach.root FROM reach JOIN near ON near.s = reach.node), parts AS (SELECT node, min(root) AS part FROM reach GROUP BY 1),
sized AS (SELECT part, count(*) AS n FROM parts GROUP BY 1 HAVING count(*) >= 3), placed AS (SELECT part, row_number() OVER (ORDER BY n DESC, part) - 1 AS community_id FROM sized)
SELECT community_id, node FROM parts JOIN placed USING (part)""")
def community_repair(spark, d):
    return prep.repaired(D.copart(spark, d), D.brands(spark, d))


__all__ = ["METHODS", "QUERIES", "SQL", "local"]
