"""Preparation of datasets, sampling, adjacency kinds and further set measures, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, prep, structure
from ..operators.search import search, structural
from ..sources import derived as D
from .structural import _CORES_40, _H1, _SCORES, _r, scores

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_E2, _E1, _E7, _A = D.SQL_COPART2, D.SQL_COPART, D.SQL_COPART7, D.SQL_ADJ


def _draw(seed: int, *columns: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(columns)}))"


def _number(seed: int, *columns: str) -> str:
    return f"('0x' || substr({_draw(seed, *columns)}, 1, 15))::BIGINT"


@query("vertex_samples", f"WITH r AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY {_draw(0, 'p_partkey')}, p_partkey) AS i, count(*) OVER () AS n FROM part) SELECT pct::INT AS pct, node FROM r, (SELECT unnest([20, 40, 60, 80]) AS pct) WHERE i <= n * pct // 100")
def vertex_samples(spark, d):
    return prep.vertex_samples(D.table(spark, d, "part").select(F.col("p_partkey").alias("node")))


def _deltas(edges: str) -> str:
    """As many partners drawn for each vertex as suffice on these tables at once."""
    return f"""WITH {edges}, m AS (SELECT count(*) AS n FROM e), x AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS r, count(*) OVER () AS k FROM (SELECT u AS node FROM e UNION SELECT v FROM e)),
d AS (SELECT node, k, unnest(range(0, 2 * (n * 30 // 100) // k + 2)) AS i FROM x, m), w AS (SELECT least(d.node, x.node) AS u, greatest(d.node, x.node) AS v FROM d JOIN x ON x.r = {_number(100, 'd.node', 'd.i')} % d.k WHERE d.node <> x.node),
r AS (SELECT 'del' AS op, u, v, row_number() OVER (ORDER BY {_draw(0, 'u', 'v')}, u, v) AS i FROM e UNION ALL SELECT 'add', u, v, row_number() OVER (ORDER BY {_draw(1, 'u', 'v')}, u, v) FROM (SELECT DISTINCT u, v FROM w) ANTI JOIN e USING (u, v))
SELECT op, pct::INT AS pct, u, v FROM r, m, (SELECT unnest([10, 20, 30]) AS pct) WHERE i <= n * pct // 100"""


@query("edge_deltas", _deltas(_E2))
def edge_deltas(spark, d):
    return prep.edge_deltas(D.copart2(spark, d))


@query("edge_deltas_dense", _deltas(D.SQL_COPART7))
def edge_deltas_dense(spark, d):
    return prep.edge_deltas(D.copart7(spark, d))


_TURNS = f"""s AS (SELECT community, count(*) AS m FROM c GROUP BY community HAVING count(*) >= 2), t AS (SELECT *, row_number() OVER (ORDER BY {_draw(0, 'community')}, community) - 1 AS t, count(*) OVER () AS k FROM s),
r AS (SELECT community, node, row_number() OVER (PARTITION BY community ORDER BY {_draw(0, 'community', 'node')}, node) - 1 AS r FROM c)"""


@query("query_sampling", f"WITH {D.SQL_BRANDS}, {_TURNS}, q AS (SELECT *, unnest(range(t, 100, k)) AS query_id FROM t WHERE t < 100), p AS (SELECT *, unnest([0, 1]) AS pos FROM q) SELECT query_id, pos, node, p.community FROM p JOIN r ON p.community = r.community AND r.r = (query_id // k * 2 + pos) % m")
def query_sampling(spark, d):
    return prep.sample_queries(D.brands(spark, d), 100, 2)


@query("split_communities", f"WITH c AS (SELECT DISTINCT p_brand AS community FROM part) SELECT community, CASE WHEN row_number() OVER (ORDER BY {_draw(0, 'community')}, community) <= ceil(count(*) OVER () * 0.5) THEN 'train' ELSE 'test' END AS side FROM c")
def split_communities(spark, d):
    return prep.split_communities(D.brands(spark, d))


@query("boundary_pairs", f"""WITH {_E2}, {_A}, {D.SQL_BRANDS}, b AS (SELECT c.community, c.node, EXISTS (SELECT 1 FROM adj JOIN c o ON adj.d = o.node WHERE adj.s = c.node AND o.community <> c.community) AS boundary FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY community, boundary ORDER BY {_draw(0, 'community', 'node')}, node) AS r FROM b)
SELECT x.community, x.node AS boundary_node, y.node AS interior_node FROM r x JOIN r y ON x.community = y.community AND x.r = y.r WHERE x.boundary AND NOT y.boundary ORDER BY x.r, {_draw(0, 'x.community')}, x.community LIMIT 101""")
def boundary_pairs(spark, d):
    return prep.boundary_pairs(D.copart2(spark, d), D.brands(spark, d), 100)


@query("nested_queries", "WITH r AS (SELECT p_brand AS query_id, p_partkey AS node, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS pos FROM part) SELECT qsize::INT AS qsize, query_id, pos, node FROM r, (SELECT unnest([1, 2, 4, 6, 8]) AS qsize) WHERE pos < qsize")
def nested_queries(spark, d):
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    longest = D.table(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("node"), (F.row_number().over(order) - 1).alias("pos"))
    return prep.nested_queries(longest)


_PARTS = "i AS (SELECT c.community, adj.s, adj.d FROM adj JOIN c ON adj.s = c.node JOIN c o ON adj.d = o.node AND o.community = c.community), h AS (SELECT community, node, node AS label FROM c UNION SELECT h.community, i.d, h.label FROM h JOIN i ON h.community = i.community AND h.node = i.s WHERE h.label < i.d), part_of AS (SELECT community, node, min(label) AS part FROM h GROUP BY ALL)"


@query("repaired_truth", f"WITH RECURSIVE {_E1}, {_A}, {D.SQL_BRANDS}, {_PARTS}, q AS (SELECT community, min(node) AS node FROM c GROUP BY 1) SELECT p.community AS query_id, p.node FROM part_of p JOIN part_of x ON p.community = x.community AND p.part = x.part JOIN q ON q.community = x.community AND q.node = x.node")
def repaired_truth(spark, d):
    truth = D.brands(spark, d).withColumnRenamed("community", "query_id")
    return prep.repaired_truth(D.copart(spark, d), truth.groupBy("query_id").agg(F.min("node").alias("node")), truth)[1]


@query("free_riders", f"WITH RECURSIVE {_E1}, {_A}, {D.SQL_BRANDS}, {_PARTS}, n AS (SELECT community, part, count(*) AS n, sum(1.0::DOUBLE + node % 5) AS w FROM part_of GROUP BY ALL), k AS (SELECT a.community, a.part, count(*) AS k FROM e JOIN part_of a ON u = a.node JOIN part_of b ON v = b.node AND a.community = b.community GROUP BY ALL), t AS (SELECT n.*, coalesce(k, 0) / w AS density FROM n LEFT JOIN k USING (community, part)) SELECT community, part, n, round(density, 9) AS density, row_number() OVER (PARTITION BY community ORDER BY round(density, 12) DESC, part) = 1 AS main FROM t")
def free_riders(spark, d):
    weights = D.table(spark, d, "part").select(F.col("p_partkey").alias("node"), (1.0 + F.col("p_partkey") % 5).alias("w"))
    return metrics.free_riders(D.copart(spark, d), D.brands(spark, d), weights).withColumn("density", _r("density"))


@query("soft_overlaps", f"WITH {D.SQL_QUERIES}, {_SCORES}, t AS (SELECT q.node AS q, b.p_partkey AS node FROM q JOIN part a ON a.p_partkey = q.node JOIN part b ON a.p_brand = b.p_brand), x AS (SELECT sc.q, score AS x, t.node IS NOT NULL AS t FROM sc LEFT JOIN t ON sc.q = t.q AND sc.node = t.node), s AS (SELECT q, sum(least(x, t::INT::DOUBLE)) AS low, sum(greatest(x, t::INT::DOUBLE)) AS high, sum((x > 0.5 AND t)::INT) AS tp, sum((x > 0.5)::INT) AS p, sum(t::INT) AS n FROM x GROUP BY q) SELECT q AS query_id, round(low / high, 9) AS iou, round(2.0::DOUBLE * tp / (p + n), 9) AS f1 FROM s")
def soft_overlaps(spark, d):
    parts = D.table(spark, d, "part")
    first = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("query_id"))
    truth = parts.join(first, "p_brand").select("query_id", F.col("p_partkey").alias("node"))
    return metrics.soft_overlaps(scores(spark, d), truth).withColumns({"iou": _r("iou"), "f1": _r("f1")})


@query("adjacency_kinds", f"""WITH {_E2}, {_A}, g AS (SELECT s AS node, count(*)::DOUBLE AS k FROM adj GROUP BY s), lo AS (SELECT s, d FROM adj UNION ALL SELECT node, node FROM g),
p AS (SELECT adj.s, adj.d, a.k AS x, b.k AS y FROM adj JOIN g a ON s = a.node JOIN g b ON d = b.node), o AS (SELECT lo.s, lo.d, a.k + 1 AS x, b.k + 1 AS y FROM lo JOIN g a ON s = a.node JOIN g b ON d = b.node),
w AS (SELECT 'none' AS kind, s, d, 1.0::DOUBLE AS w FROM p UNION ALL SELECT 'self', s, d, 1 FROM o UNION ALL SELECT 'sym', s, d, 1 / sqrt(x * y) FROM p UNION ALL SELECT 'aug', s, d, 1 / sqrt(x * y) FROM o UNION ALL SELECT 'row', s, d, 1 / x FROM p UNION ALL SELECT 'aug_row', s, d, 1 / x FROM o
UNION ALL SELECT 'first_order', s, d, 1 / sqrt(x * y) FROM p UNION ALL SELECT 'first_order', node, node, 1 FROM g UNION ALL SELECT 'aug_plus', s, d, 1 / sqrt(x * y) + (s = d)::INT FROM o UNION ALL SELECT 'lap', s, d, -1 / sqrt(x * y) FROM p UNION ALL SELECT 'lap', node, node, 1 FROM g
UNION ALL SELECT 'row_lap', s, d, -1 / x FROM p UNION ALL SELECT 'row_lap', node, node, 1 FROM g UNION ALL SELECT 'laplacian', s, d, -1 FROM p UNION ALL SELECT 'laplacian', node, node, k FROM g) SELECT kind, s, d, round(w, 9) AS w FROM w""")
def adjacency_kinds(spark, d):
    edges, out = D.copart2(spark, d), None
    for kind in structure.ADJACENCY_KINDS:
        one = structure.normalised_adjacency(edges, kind).select(F.lit(kind).alias("kind"), "s", "d", _r("w").alias("w"))
        out = one if out is None else out.unionByName(one)
    return out


@query("hindex_vectors", f"WITH {_E7}, {_A}, {_H1}, n AS (SELECT s AS node, d FROM adj UNION ALL SELECT node, node FROM h1), t AS (SELECT n.node, h1.value AS h, count(*) AS n FROM n JOIN h1 ON n.d = h1.node GROUP BY ALL) SELECT node, h, round(n / sum(n) OVER (PARTITION BY node), 9) AS share FROM t")
def hindex_vectors(spark, d):
    return structure.h_index_vectors(D.copart7(spark, d)).withColumn("share", _r("share"))


@query("conductance_hops", f"""WITH {_E2}, {_A}, w2 AS MATERIALIZED (SELECT a.s, b.d, count(*) AS n FROM adj a JOIN adj b ON a.d = b.s GROUP BY ALL), w3 AS (SELECT a.s, b.d, sum(n) AS n FROM w2 a JOIN adj b ON a.d = b.s GROUP BY ALL),
x AS (SELECT d AS node, 0 AS hop, (sum(n) - count(*))::BIGINT AS excess FROM w2 GROUP BY d UNION ALL SELECT d, 1, (sum(n) - count(*))::BIGINT FROM w3 GROUP BY d), b AS (SELECT *, first_value(hop) OVER (PARTITION BY node ORDER BY excess DESC, hop) AS best FROM x) SELECT node, hop::INT AS hop, excess, CASE WHEN hop > best AND best <> 0 THEN 0 ELSE 1 END::INT AS keep FROM b""")
def conductance_hops(spark, d):
    return structure.conductance_hops(D.copart2(spark, d))


def _trim(rounds: int) -> str:
    out = ["b0 AS MATERIALIZED (SELECT p_partkey AS node FROM part)"]
    for i in range(rounds):
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT x.node FROM b{i} x LEFT JOIN (SELECT s, count(*) AS k FROM adj JOIN b{i} y ON adj.d = y.node GROUP BY s) g ON g.s = x.node WHERE coalesce(k, 0) / (1.0::DOUBLE + x.node % 5) >= 8)")
    return ", ".join(out)


TRIM_ROUNDS = 40


@query("biased_core", f"WITH {_E7}, {_A}, {_trim(TRIM_ROUNDS)} SELECT node FROM b{TRIM_ROUNDS}")
def biased_core(spark, d):
    weights = D.table(spark, d, "part").select(F.col("p_partkey").alias("node"), (1.0 + F.col("p_partkey") % 5).alias("w"))
    return structure.biased_core(D.copart7(spark, d), weights, 8.0)


@query("kcore_max_search", f"""WITH RECURSIVE {_E7}, {_A}, {_CORES_40}, q AS (SELECT min(p_partkey) AS q, unnest([min(p_partkey), max(p_partkey)]) AS node FROM part GROUP BY p_brand), kq AS (SELECT q, max(core) AS k FROM q JOIN core USING (node) GROUP BY q),
r AS (SELECT kq.q, k, q.node AS start, q.node FROM kq JOIN q USING (q) JOIN core USING (node) WHERE core >= k UNION SELECT r.q, r.k, r.start, adj.d FROM r JOIN adj ON r.node = adj.s JOIN core ON adj.d = core.node WHERE core.core >= r.k),
la AS (SELECT q, start, min(node) AS label FROM r GROUP BY ALL), m AS (SELECT q, min(label) AS label FROM la GROUP BY q) SELECT DISTINCT r.q AS query_id, r.node FROM r JOIN la USING (q, start) JOIN m USING (q, label)""")
def kcore_max_search(spark, d):
    ends = D.table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("query_id"), F.max("p_partkey").alias("last"))
    return search("kcore", D.copart7(spark, d), ends.select("query_id", F.explode(F.array("query_id", "last")).alias("node")), use_max=True)


# Maximal cliques: each grows by its common neighbours beyond its last vertex; one without common neighbours is maximal.
_CLIQUES = "nb AS MATERIALIZED (SELECT s, list(d) AS ns FROM adj GROUP BY s), cl AS (SELECT [u, v] AS c, list_intersect(a.ns, b.ns) AS n FROM e JOIN nb a ON a.s = u JOIN nb b ON b.s = v UNION ALL SELECT list_append(c, w), list_intersect(n, ns) FROM (SELECT c, n, unnest(list_filter(n, lambda x: x > c[-1])) AS w FROM cl) x JOIN nb ON nb.s = x.w), mc AS MATERIALIZED (SELECT array_to_string(c, '_') AS clique, c FROM cl WHERE len(n) = 0)"


@query("maximal_cliques", f"WITH RECURSIVE {_E2}, {_A}, {_CLIQUES} SELECT clique, len(c)::INT AS size FROM mc")
def maximal_cliques(spark, d):
    return structure.cliques(D.copart2(spark, d)).select(F.array_join(F.transform("clique", lambda x: x.cast("string")), "_").alias("clique"), F.size("clique").alias("size"))


_PERCOLATE = "cv AS MATERIALIZED (SELECT clique, len(c) AS size, unnest(c) AS node FROM mc), ov AS MATERIALIZED (SELECT a.clique AS x, b.clique AS y, count(*) AS n FROM cv a JOIN cv b ON a.node = b.node AND a.clique <> b.clique GROUP BY ALL), ks AS (SELECT unnest({ks}) AS k), gr AS (SELECT k, clique AS root, clique FROM ks JOIN mc ON len(c) >= k UNION SELECT gr.k, gr.root, y FROM gr JOIN ov ON gr.clique = x JOIN mc ON mc.clique = y WHERE n >= gr.k - 1 AND len(mc.c) >= gr.k), pc AS MATERIALIZED (SELECT k, clique, min(root) AS root FROM gr GROUP BY ALL), pm AS MATERIALIZED (SELECT DISTINCT k, root, node FROM pc JOIN cv USING (clique)), fc AS (SELECT k, root, min(c) AS first FROM pc JOIN mc USING (clique) GROUP BY ALL), sz AS (SELECT k, root, count(*) AS n, min(node) AS low FROM pm GROUP BY ALL), pick AS (SELECT q.node AS q, pm.k, pm.root, row_number() OVER (PARTITION BY q.node ORDER BY pm.k DESC, n DESC, low, first) AS i FROM q JOIN pm USING (node) JOIN sz USING (k, root) JOIN fc USING (k, root)), got AS (SELECT q, pm.node FROM pick JOIN pm USING (k, root) WHERE i = 1) SELECT q AS query_id, node FROM got UNION SELECT node, node FROM q WHERE node NOT IN (SELECT q FROM got)"


@query("kclique_search", f"WITH RECURSIVE {_E2}, {_A}, {D.SQL_QUERIES}, {_CLIQUES}, {_PERCOLATE.format(ks='[3]')}")
def kclique_search(spark, d):
    return search("kclique", D.copart2(spark, d), D.brand_queries(spark, d), k=3)


@query("kclique_densest_search", f"WITH RECURSIVE {_E2}, {_A}, {D.SQL_QUERIES}, {_CLIQUES}, {_PERCOLATE.format(ks='range(3, (SELECT max(len(c)) + 1 FROM mc))')}")
def kclique_densest_search(spark, d):
    return search("kclique_densest", D.copart2(spark, d), D.brand_queries(spark, d))


def _votes(rounds: int) -> str:
    parts = ["p0 AS (SELECT DISTINCT s AS node, s AS part FROM adj)"]
    for i in range(rounds):
        parts.append(f"p{i + 1} AS MATERIALIZED (SELECT node, part FROM (SELECT node, part, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, part) AS i FROM (SELECT adj.s AS node, part FROM adj JOIN p{i} p ON adj.d = p.node UNION ALL SELECT node, part FROM p{i}) GROUP BY node, part) WHERE i = 1)")
    return ", ".join(parts)


@query("label_partition", f"WITH {_E2}, {_A}, {_votes(5)} SELECT node, part FROM p5")
def label_partition(spark, d):
    return structure.label_partition(D.copart2(spark, d))


__all__ = ["QUERIES", "SQL", "structural"]
