"""Readers and writers by round trips, stored indexes, class sizes, splits and stress variants, measured runs and labels, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import analytics, index, prep, recommend, structure
from ..operators.densest import densest
from ..operators.search import search
from ..plans.iterate import shared_folder, stored
from ..sources import derived as D
from ..sources import text
from .relational import _PRED, measured, truth
from .structural import _CORES_40, _SCORES, _TRI, _TRUSS_LINKS, CORE_ROUNDS, TRUSS_ROUNDS, _cores, _r, _truss, scores

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_E1, _E2, _E7, _A, _B = D.SQL_COPART, D.SQL_COPART2, D.SQL_COPART7, D.SQL_ADJ, D.SQL_BRANDS


def _new(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _parts(spark, d):
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("node"))


def _draw(seed: int, *columns: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(columns)}))"


# Round trips through text and tables.


@query("edge_text_round_trip", f"WITH {_E2} SELECT u, v FROM e")
def edge_text_round_trip(spark, d):
    path = _new(spark, "edges")
    text.write_edges(D.copart2(spark, d), path)
    return text.read_edges(spark, path)


@query("community_text_round_trip", "SELECT dense_rank() OVER (ORDER BY p_brand)::BIGINT - 1 AS community_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT - 1 AS pos, p_partkey AS node FROM part")
def community_text_round_trip(spark, d):
    path = _new(spark, "communities")
    text.write_members(D.brands(spark, d), path, "community")
    return text.read_members(spark, path)


@query("feature_text_round_trip", "SELECT p_partkey AS id, p_size::DOUBLE AS feat FROM part")
def feature_text_round_trip(spark, d):
    path = _new(spark, "features")
    D.table(spark, d, "part").select(F.concat_ws("  ", "p_partkey", F.col("p_size").cast("double")).alias("value")).write.text(path)
    return text.read_features(spark, path)


@query("snap_dense_ids", f"WITH {_E2}, o AS (SELECT u * 10 AS a, v * 10 AS b, row_number() OVER (ORDER BY u, v) - 1 AS l FROM e), s AS (SELECT a AS old_id, 2 * l AS i FROM o UNION ALL SELECT b, 2 * l + 1 FROM o), m AS (SELECT old_id, min(i) AS i FROM s GROUP BY 1) SELECT row_number() OVER (ORDER BY i) - 1 AS id, old_id FROM m")
def snap_dense_ids(spark, d):
    path = _new(spark, "snap")
    D.copart2(spark, d).orderBy("u", "v").select(F.concat_ws("\t", F.col("u") * 10, F.col("v") * 10).alias("value")).write.text(path)
    return text.read_snap(spark, path)[1]


@query("snap_communities", f"WITH {_E2}, o AS (SELECT u * 10 AS a, v * 10 AS b, row_number() OVER (ORDER BY u, v) - 1 AS l FROM e), s AS (SELECT a AS old_id, 2 * l AS i FROM o UNION ALL SELECT b, 2 * l + 1 FROM o), m AS (SELECT old_id, min(i) AS i FROM s GROUP BY 1), k AS (SELECT row_number() OVER (ORDER BY i) - 1 AS id, old_id FROM m) SELECT c, id AS node FROM (SELECT p_brand AS c, dense_rank() OVER (ORDER BY p_brand) - 1 AS n, p_partkey * 10 AS p FROM part) JOIN k ON p = old_id".replace("SELECT c, id AS node", "SELECT n::BIGINT AS community_id, id AS node"))
def snap_communities(spark, d):
    edges, members = _new(spark, "snap"), _new(spark, "snapc")
    D.copart2(spark, d).orderBy("u", "v").select(F.concat_ws("\t", F.col("u") * 10, F.col("v") * 10).alias("value")).write.text(edges)
    text.write_members(D.brands(spark, d).withColumn("node", F.col("node") * 10), members, "community")
    return text.read_snap_communities(spark, members, text.read_snap(spark, edges)[1])


@query("email_communities", "SELECT p_size::BIGINT AS community_id, p_partkey AS node FROM part")
def email_communities(spark, d):
    path = _new(spark, "email")
    D.table(spark, d, "part").select(F.concat_ws(" ", "p_partkey", "p_size").alias("value")).write.text(path)
    return text.read_email_communities(spark, path)


@query("split_queries", "SELECT s AS split, dense_rank() OVER (PARTITION BY s ORDER BY p_brand)::BIGINT - 1 AS query_id, p_partkey - 1 AS node FROM part, (VALUES ('train', 0), ('valid', 1), ('test', 2)) t(s, i) WHERE p_size % 3 = i QUALIFY query_id < 5")
def split_queries(spark, d):
    folder = _new(spark, "splits")
    rows = D.table(spark, d, "part").select(F.col("p_brand").alias("community"), F.col("p_partkey").alias("node"), F.col("p_size"))
    ids = _parts(spark, d).select((F.col("node") - 1).alias("id"), F.col("node").alias("old_id"))
    for i, split in enumerate(("train", "valid", "test")):
        part = rows.filter(F.col("p_size") % 3 == i)
        text.write_members(part, f"{folder}/1_induct_{split}_gt", "community")
        text.write_members(part.groupBy("community").agg(F.min("node").alias("node")), f"{folder}/1_induct_{split}_query", "community")
    return text.read_splits(spark, folder, ids=ids, limit=5)[1].select("split", "query_id", "node")


@query("results_round_trip", f"WITH {_PRED} SELECT 'copart' AS dataset, method, query, thr, round(f1, 6) AS f1, time FROM r")
def results_round_trip(spark, d):
    path = _new(spark, "results")
    rows = measured(spark, d).withColumn("dataset", F.lit("copart"))
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in text.RESULTS.fields])
    text.write_results(full, path)
    return text.read_results(spark, path).select("dataset", "method", "query", "thr", "f1", "time")


@query("stats_round_trip", f"WITH {_E1}, {_B} SELECT x.dataset, x.community, x.size, x.inner_edges, CASE WHEN size > 1 THEN 2.0::DOUBLE * inner_edges / (size * (size - 1)) ELSE 0 END AS density FROM (SELECT CASE WHEN k.community < 'Brand#3' THEN 'low' ELSE 'high' END AS dataset, k.community, k.size, coalesce(i.n, 0) AS inner_edges FROM (SELECT community, count(*) AS size FROM c GROUP BY 1) k LEFT JOIN (SELECT a.community, count(*) AS n FROM e JOIN c a ON u = a.node JOIN c b ON v = b.node AND a.community = b.community GROUP BY 1) i USING (community)) x".replace("SELECT x.dataset, x.community, x.size, x.inner_edges, CASE", "SELECT x.dataset, x.community, x.size, x.inner_edges, round(CASE").replace("ELSE 0 END AS density", "ELSE 0 END, 9) AS density"))
def stats_round_trip(spark, d):
    path = _new(spark, "stats")
    stats = analytics.community_stats(D.copart(spark, d), D.brands(spark, d))
    text.write_stats(stats.withColumn("dataset", F.when(F.col("community") < "Brand#3", "low").otherwise("high")), path)
    return text.read_stats(spark, f"{path}/*").select("dataset", "community", "size", "inner_edges", _r("density").alias("density"))


@query("run_summary_append", f"WITH {_PRED} SELECT method, count(*) AS n, round(avg(f1), 6) AS mean_f1, b AS batch FROM r, (VALUES (1), (2)) t(b) GROUP BY method, b")
def run_summary_append(spark, d):
    path = _new(spark, "summary")
    rows = measured(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("mean_f1"))
    for batch in (1, 2):
        text.append_rows(rows.withColumn("batch", F.lit(batch)), path)
    return spark.read.parquet(path)


# Stored indexes.


@query("truss_index_edges", f"WITH {_E7}, {_TRI}, {_truss(TRUSS_ROUNDS)} SELECT u, v, truss FROM truss")
def truss_index_edges(spark, d):
    path = _new(spark, "index")
    index.save({"edges": structure.truss_numbers(D.copart7(spark, d))}, path)
    return index.load(spark, path, "edges")


@query("truss_index_search", f"""WITH RECURSIVE {_E2}, {_TRI}, {_TRUSS_LINKS.replace('>= 8', '>= 3')}, {D.SQL_QUERIES},
r AS (SELECT q.node AS q, u || '-' || v AS k FROM q JOIN s ON q.node = u OR q.node = v UNION SELECT r.q, lk.b FROM r JOIN lk ON r.k = lk.a)
SELECT DISTINCT q AS query_id, unnest([split_part(k, '-', 1), split_part(k, '-', 2)])::BIGINT AS node FROM r""")
def truss_index_search(spark, d):
    path = _new(spark, "index")
    index.save(index.truss_index(D.copart2(spark, d)), path)
    return index.truss_search(index.load(spark, path, "groups"), D.brand_queries(spark, d), 3)


# Sizes, labels, statistics by group.

_REACH = "reach AS (SELECT s AS node, s AS label FROM adj UNION SELECT adj.d, reach.label FROM reach JOIN adj ON reach.node = adj.s WHERE reach.label < adj.d), cc AS (SELECT node, min(label) AS component FROM reach GROUP BY node)"


@query("component_sizes", f"WITH RECURSIVE {_E2}, {_A}, {_REACH} SELECT component, count(*) AS n FROM cc GROUP BY 1")
def component_sizes(spark, d):
    return analytics.class_sizes(structure.components(D.copart2(spark, d)), "component")


@query("shell_sizes", f"WITH {_E2}, {_A}, {_cores(CORE_ROUNDS)} SELECT core, count(*) AS n FROM core GROUP BY 1")
def shell_sizes(spark, d):
    return analytics.class_sizes(structure.core_numbers(D.copart2(spark, d)), "core")


@query("truss_class_sizes", f"WITH {_E2}, {_TRI}, {_truss(TRUSS_ROUNDS)} SELECT truss, count(*) AS n FROM truss GROUP BY 1")
def truss_class_sizes(spark, d):
    return analytics.class_sizes(structure.truss_numbers(D.copart2(spark, d)), "truss")


@query("distinct_communities", "WITH m AS (SELECT CASE WHEN i = 0 THEN p_brand ELSE 'copy of ' || p_brand END AS community, p_partkey AS node FROM part, (VALUES (0), (1)) t(i)), s AS (SELECT community, list_sort(list(node)) AS nodes FROM m GROUP BY 1), k AS (SELECT min(community) AS community FROM s GROUP BY nodes) SELECT community, node FROM m JOIN k USING (community)")
def distinct_communities(spark, d):
    rows = D.brands(spark, d)
    return analytics.distinct_communities(rows.unionByName(rows.withColumn("community", F.concat(F.lit("copy of "), "community"))))


@query("community_stats_by_group", f"WITH {_E1}, {_B}, k AS (SELECT community, count(*) AS size FROM c GROUP BY 1), i AS (SELECT a.community, count(*) AS n FROM e JOIN c a ON u = a.node JOIN c b ON v = b.node AND a.community = b.community GROUP BY 1), t AS (SELECT substr(community, 1, 7) AS maker, size, CASE WHEN size > 1 THEN 2.0::DOUBLE * coalesce(n, 0) / (size * (size - 1)) ELSE 0 END AS density FROM k LEFT JOIN i USING (community)) SELECT maker, count(*) AS n_communities, {', '.join(f'round({f}({c}::DOUBLE), 4) AS {c}_{n}' for c in ('size', 'density') for f, n in (('min', 'min'), ('max', 'max'), ('avg', 'mean'), ('median', 'median')))} FROM t GROUP BY maker")
def community_stats_by_group(spark, d):
    stats = analytics.community_stats(D.copart(spark, d), D.brands(spark, d))
    return analytics.stats_summary(stats.withColumn("maker", F.substring("community", 1, 7)), "maker")


@query("layout_sizes", "WITH k AS (SELECT substr(p_brand, 1, 7) AS maker, p_brand AS community, count(*) AS size, avg(p_size) / 50 AS density FROM part GROUP BY 1, 2) SELECT community, round(pow(size / max(size) OVER (PARTITION BY maker), 0.2), 9) AS radius, round(density / max(density) OVER (PARTITION BY maker), 9) AS fill FROM k")
def layout_sizes(spark, d):
    part = D.table(spark, d, "part")
    stats = part.groupBy(F.substring("p_brand", 1, 7).alias("maker"), F.col("p_brand").alias("community")).agg(F.count(F.lit(1)).alias("size"), (F.avg("p_size") / 50).alias("density"))
    return analytics.layout_sizes(stats, "maker").select("community", _r("radius").alias("radius"), _r("fill").alias("fill"))


@query("count_labels", "SELECT p_brand, p_brand || '_' || count(*) AS label FROM part GROUP BY 1")
def count_labels(spark, d):
    return D.table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).select("p_brand", X.label_count(F.col("p_brand"), F.col("n")).alias("label"))


@query("scaled_degree_profile", f"WITH {_E2}, {_A}, g AS (SELECT s AS node, count(*) AS degree FROM adj GROUP BY s), p AS (SELECT adj.s AS node, count(*)::DOUBLE AS degree, min(k.degree)::DOUBLE AS nbr_min, max(k.degree)::DOUBLE AS nbr_max, avg(k.degree) AS nbr_mean, stddev_pop(k.degree) AS nbr_std FROM adj JOIN g k ON adj.d = k.node GROUP BY 1) SELECT node, {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}' for c in ('degree', 'nbr_min', 'nbr_max', 'nbr_mean', 'nbr_std'))} FROM p")
def scaled_degree_profile(spark, d):
    out = structure.degree_profile(D.copart2(spark, d), scaled=True)
    return out.select("node", *[_r(c, 6).alias(c) for c in out.columns[1:]])


# Preparation.


@query("node_splits", f"WITH r AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY {_draw(0, 'p_partkey')}, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT node, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'valid' ELSE 'test' END AS split FROM r")
def node_splits(spark, d):
    return prep.node_splits(_parts(spark, d))


@query("class_splits", f"WITH r AS (SELECT p_partkey AS node, p_brand AS label, row_number() OVER (PARTITION BY p_brand ORDER BY {_draw(0, 'p_partkey')}, p_partkey) AS i FROM part) SELECT node, label, CASE WHEN i <= 3 THEN 'train' WHEN i <= 6 THEN 'valid' ELSE 'test' END AS split FROM r")
def class_splits(spark, d):
    return prep.class_splits(D.brands(spark, d).withColumnRenamed("community", "label"), 3)


@query("positive_samples", f"WITH {D.SQL_QUERIES}, g AS (SELECT q.node AS query_id, y.p_partkey AS node FROM q JOIN part x ON q.node = x.p_partkey JOIN part y ON x.p_brand = y.p_brand WHERE q.node <> y.p_partkey) SELECT query_id, node FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_draw(0, 'query_id', 'node')}, node) <= 3")
def positive_samples(spark, d):
    return prep.positive_samples(D.brand_queries(spark, d), truth(spark, d))


@query("attached_vertices", f"WITH {_E2}, x AS (SELECT node, row_number() OVER (ORDER BY {_draw(0, 'node')}, node) - 1 AS r, count(*) OVER () AS n FROM (SELECT u AS node FROM e UNION SELECT v FROM e)), t AS (SELECT -a AS u, i FROM range(1, 11) t(a), range(0, 3) s(i)), w AS (SELECT t.u, ('0x' || substr({_draw(0, 't.u', 't.i')}, 1, 15))::BIGINT % (SELECT max(n) FROM x) AS r FROM t) SELECT u, v FROM e UNION SELECT w.u, x.node FROM w JOIN x USING (r)")
def attached_vertices(spark, d):
    return prep.attached(D.copart2(spark, d), 10, 3)


@query("without_core_class", f"WITH {_E2}, {_A}, {_cores(16)}, k AS (SELECT node, row_number() OVER (ORDER BY {_draw(0, 'node')}, node) - 1 AS r, count(*) OVER () AS n FROM core WHERE core BETWEEN 2 AND 3), g AS (SELECT node FROM k WHERE r < floor(n * 0.5)) SELECT e.u, e.v FROM e ANTI JOIN g ON e.u = g.node ANTI JOIN g h ON e.v = h.node")
def without_core_class(spark, d):
    edges = D.copart2(spark, d)
    return prep.without_core_class(edges, structure.core_numbers(edges), 2, 3, 0.5)


@query("masked_truth", f"WITH RECURSIVE {_E1}, {_A}, {D.SQL_QUERIES}, g AS (SELECT q.node AS query_id, y.p_partkey AS node FROM q JOIN part x ON q.node = x.p_partkey JOIN part y ON x.p_brand = y.p_brand), r AS (SELECT node AS query_id, node, 0 AS dist FROM q UNION SELECT r.query_id, adj.d, dist + 1 FROM r JOIN adj ON r.node = adj.s JOIN g ON g.query_id = r.query_id AND g.node = adj.d WHERE dist < 12), m AS (SELECT query_id, node, min(dist) AS dist FROM r GROUP BY ALL) SELECT query_id, node FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, node) <= 6")
def masked_truth(spark, d):
    return prep.nearest_members(stored(D.copart(spark, d), "copart"), D.brand_queries(spark, d), truth(spark, d), 6)


@query("random_walks", "WITH " + f"{_E2}, {_A}, w0 AS (SELECT DISTINCT s AS walk, 0 AS step, s AS node FROM adj), " + ", ".join(f"w{i} AS (SELECT w.walk, {i} AS step, arg_min(adj.d, {_draw(0, 'w.walk', str(i), 'adj.d')}) AS node FROM w{i - 1} w JOIN adj ON adj.s = w.node GROUP BY w.walk)" for i in (1, 2, 3)) + " FROM w0 UNION ALL FROM w1 UNION ALL FROM w2 UNION ALL FROM w3")
def random_walks(spark, d):
    edges = D.copart2(spark, d)
    return prep.random_walks(edges, structure.degrees(edges).select("node"))


@query("rollout_samples")
def rollout_samples(spark, d):
    return prep.rollout_samples(stored(D.copart(spark, d), "copart"), D.brands(spark, d))


def _inductive(split: str, side: str, n: int, seed: int) -> str:
    return f"""SELECT '{split}' AS split, query_id, node, community FROM (
SELECT t.*, unnest(range(t, {n}, k)) AS query_id FROM (SELECT community, m, row_number() OVER (ORDER BY {_draw(seed, 'community')}, community) - 1 AS t, count(*) OVER () AS k FROM (SELECT community, count(*) AS m FROM c JOIN sides USING (community) WHERE side = '{side}' GROUP BY 1)) t WHERE t < {n}
) JOIN (SELECT community, node, row_number() OVER (PARTITION BY community ORDER BY {_draw(seed, 'community', 'node')}, node) - 1 AS r FROM c) x USING (community) WHERE r = (query_id // k) % m"""


@query("inductive_samples", f"""WITH {_B}, sides AS (SELECT community, CASE WHEN row_number() OVER (ORDER BY {_draw(0, 'community')}, community) <= ceil(count(*) OVER () * 0.5) THEN 'train' ELSE 'test' END AS side FROM (SELECT DISTINCT community FROM c))
{_inductive('train', 'train', 150, 0)} UNION ALL {_inductive('valid', 'train', 100, 1)} UNION ALL {_inductive('test', 'test', 100, 2)}""")
def inductive_samples(spark, d):
    return prep.inductive_samples(D.brands(spark, d))


@query("random_queries", f"""WITH q AS (SELECT i AS query_id, ('0x' || substr(md5('0|' || i), 1, 8))::BIGINT % 10 AS s FROM range(50) t(i)), w AS (SELECT query_id, unnest(range(0, CASE WHEN s < 7 THEN 1 WHEN s < 9 THEN 2 ELSE 3 END)) AS pos FROM q),
o AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY {_draw(0, 'p_partkey')}, p_partkey) - 1 AS r, count(*) OVER () AS n FROM part) SELECT query_id, pos::INT AS pos, node FROM w JOIN o ON r = (query_id * 3 + pos) % n""")
def random_queries(spark, d):
    return prep.random_queries(_parts(spark, d), 50)


# Measured runs, recommendation, labels.


@query("measured_runs", f"""WITH RECURSIVE {_E7}, {_A}, {_cores(CORE_ROUNDS)}, {D.SQL_QUERIES}, kq AS (SELECT q.node AS q, core AS k FROM q JOIN core USING (node)),
r AS (SELECT q, k, q AS node FROM kq UNION SELECT r.q, r.k, adj.d FROM r JOIN adj ON r.node = adj.s JOIN core ON adj.d = core.node WHERE core.core >= r.k),
n AS (SELECT q, q AS node FROM kq UNION SELECT q, d FROM kq JOIN adj ON s = q UNION SELECT q, b.d FROM kq JOIN adj a ON a.s = q JOIN adj b ON a.d = b.s),
p AS (SELECT 'kcore' AS method, q, node FROM r UNION SELECT 'csformer', n.q, n.node FROM n JOIN kq USING (q) JOIN core ON core.node = n.node WHERE core >= k UNION SELECT 'kcore', node, node FROM q UNION SELECT 'csformer', node, node FROM q),
g AS (SELECT q.node AS q, y.p_partkey AS node FROM q JOIN part x ON q.node = x.p_partkey JOIN part y ON x.p_brand = y.p_brand), z AS (SELECT q, count(*) AS nt FROM g GROUP BY 1),
o AS (SELECT p.method, p.q, count(g.node) AS tp, count(*) AS np FROM p LEFT JOIN g ON p.q = g.q AND p.node = g.node GROUP BY 1, 2)
SELECT q::VARCHAR AS query, method, '0' AS thr, round(2.0::DOUBLE * tp / (np + nt), 9) AS f1, np::DOUBLE AS time FROM o JOIN z USING (q)""")
def measured_runs(spark, d):
    out = recommend.labelled_runs(D.copart7(spark, d), D.brand_queries(spark, d), truth(spark, d), [("kcore", "0", {}), ("csformer", "0", {})])
    return out.withColumn("f1", _r("f1"))


@query("tolerant_lookup", f"WITH {_PRED}, k AS (SELECT query, method, f1, time, thr FROM r WHERE method = 'hop1') SELECT query, f1, thr || '.0000001' AS thr, method, time, 1::BIGINT AS n_found FROM k WHERE thr = '2'")
def tolerant_lookup(spark, d):
    results = measured(spark, d)
    asked = results.filter("method = 'hop1' and thr = '2'").select("query", "method", F.concat("thr", F.lit(".0000001")).alias("thr"), F.lit(1).alias("rank"))
    return recommend.looked_up(asked, results)


@query("topk_sensitivity", f"WITH {_PRED}, b AS (SELECT query, method, max(f1) AS f1, min(time) FILTER (f1 = m) AS time FROM (SELECT *, max(f1) OVER (PARTITION BY query, method) AS m FROM r) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY method) AS i FROM b), x AS (SELECT n, query, max(f1) AS f1, sum(time) AS time FROM k, (VALUES (1), (3), (5), (7)) t(n) WHERE i <= n GROUP BY 1, 2) SELECT n AS k, round(avg(f1), 9) AS mean_f1, round(avg(time), 6) AS mean_time FROM x GROUP BY n")
def topk_sensitivity(spark, d):
    results = measured(spark, d)
    equal = results.select("query", "method").distinct().withColumn("p", F.lit(0.5))
    return recommend.sensitivity(equal, results).select("k", _r("mean_f1").alias("mean_f1"), _r("mean_time", 6).alias("mean_time"))


@query("size_labels", f"WITH {D.SQL_QUERIES}, {_SCORES}, g AS (SELECT q.node AS q, y.p_partkey AS node FROM q JOIN part x ON q.node = x.p_partkey JOIN part y ON x.p_brand = y.p_brand), z AS (SELECT q, count(*) AS nt FROM g GROUP BY 1), p AS (SELECT sc.q, score, row_number() OVER w AS size, count(g.node) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM sc LEFT JOIN g ON sc.q = g.q AND sc.node = g.node WINDOW w AS (PARTITION BY sc.q ORDER BY score DESC, sc.node)), f AS (SELECT q, size, score, 2.0::DOUBLE * tp / (size + nt) AS f1 FROM p JOIN z USING (q) WHERE abs(size - nt) <= 10) SELECT q AS query_id, size, round(f1, 9) AS f1, score AS threshold FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(f1, 12) DESC, size) = 1")
def size_labels(spark, d):
    return recommend.size_labels(scores(spark, d), truth(spark, d)).withColumn("f1", _r("f1"))


@query("sharpened_assignments", "WITH s AS (SELECT p_partkey AS node, k AS cluster, (1 + (p_partkey * 31 + k * 17) % 13) / 13.0::DOUBLE AS q FROM part, range(0, 4) t(k)), x AS (SELECT node, cluster, q * q / sum(q) OVER (PARTITION BY cluster) AS x FROM s) SELECT node, cluster, round(x / sum(x) OVER (PARTITION BY node), 9) AS p FROM x")
def sharpened_assignments(spark, d):
    soft = _parts(spark, d).withColumn("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    soft = soft.withColumn("q", (1 + (F.col("node") * 31 + F.col("cluster") * 17) % 13) / F.lit(13.0))
    return recommend.sharpened(soft).withColumn("p", _r("p"))


@query("hyperedge_means", f"WITH {_E2}, {_A}, h AS (SELECT s, d FROM adj UNION SELECT s, s FROM adj) SELECT s AS node, 0 AS j, round(avg(p_size), 9) AS x FROM h JOIN part ON d = p_partkey GROUP BY s")
def hyperedge_means(spark, d):
    features = D.table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.lit(0).alias("j"), F.col("p_size").cast("double").alias("x"))
    return recommend.hyperedge_means(structure.adjacency(D.copart2(spark, d)), features).withColumn("x", _r("x"))


@query("core_index_search", f"""WITH RECURSIVE {_E7}, {_A}, {_CORES_40}, {D.SQL_QUERIES}, kq AS (SELECT q.node AS q, core AS k FROM q JOIN core USING (node)),
r AS (SELECT q, k, q AS node FROM kq UNION SELECT r.q, r.k, adj.d FROM r JOIN adj ON r.node = adj.s JOIN core ON adj.d = core.node WHERE core.core >= r.k) SELECT q AS query_id, node FROM r""")
def core_index_search(spark, d):
    path, edges = _new(spark, "index"), D.copart7(spark, d)
    index.save({"cores": structure.core_numbers(edges)}, path)
    return search("kcore", edges, D.brand_queries(spark, d), cores=index.load(spark, path, "cores"))


# Cut vertices: with one vertex taken out, not all of its neighbours are reached from the least of them.


@query(
    "articulation_points",
    f"WITH RECURSIVE {_E2}, {_A}, near AS (SELECT s AS gone, min(d) AS node, count(*) AS n FROM adj GROUP BY s), "
    "cut AS (SELECT gone, node FROM near WHERE n > 1 UNION SELECT c.gone, a.d FROM cut c JOIN adj a ON a.s = c.node WHERE a.d <> c.gone), "
    "hit AS (SELECT a.s AS gone, count(*) AS n FROM adj a JOIN cut c ON c.gone = a.s AND c.node = a.d GROUP BY a.s) "
    "SELECT near.gone AS node FROM near JOIN hit USING (gone) WHERE hit.n < near.n",
)
def articulation_points(spark, d):
    return structure.articulation_points(D.copart2(spark, d))


@query("connectivity_index_search")
def connectivity_index_search(spark, d):
    """The answers of ``kecc_search`` from a stored forest of edge connectivities."""
    from ..operators.search import structural, with_defaults

    path = _new(spark, "connectivity")
    index.save(index.connectivity_index(D.copart2(spark, d)), path)
    asked = D.brand_queries(spark, d)
    return with_defaults(structural.kecc(D.copart2(spark, d), asked, index.load(spark, path, "forest")), asked)


def _pairs(spark, d):
    """``query_id, node``: the two smallest parts of each brand that share orders with others often enough to be in the graph."""
    known = structure.degrees(D.copart2(spark, d)).select("node")
    parts = D.brands(spark, d).join(known, "node")
    place = F.row_number().over(Window.partitionBy("community").orderBy("node"))
    first = F.min("node").over(Window.partitionBy("community"))
    return stored(parts.select(first.alias("query_id"), "node", place.alias("place")).filter("place <= 2").select("query_id", "node"), "pairs")


@query("steiner_join")
def steiner_join(spark, d):
    return search("steiner", D.copart2(spark, d), _pairs(spark, d))


@query("qdcii_search")
def qdcii_search(spark, d):
    return search("qdcii", D.copart2(spark, d), _pairs(spark, d))


@query("qdc_peel_search")
def qdc_peel_search(spark, d):
    return search("qdc_peel", D.copart2(spark, d), _pairs(spark, d))


@query("qdci_search")
def qdci_search(spark, d):
    return search("qdci", D.copart2(spark, d), _pairs(spark, d))


@query("qdc_auto_search")
def qdc_auto_search(spark, d):
    return search("qdc_auto", D.copart2(spark, d), _pairs(spark, d))


@query("densest_subgraph")
def densest_subgraph(spark, d):
    """The largest densest vertex set of the whole graph of parts that share an order of seven or more, all vertices weighing one."""
    edges = D.copart7(spark, d)
    nodes = structure.degrees(edges).select(F.lit(0).cast("long").alias("g"), "node", F.lit(1.0).alias("weight"))
    return densest(edges.select(F.lit(0).cast("long").alias("g"), "u", "v", F.lit(1.0).alias("w")), nodes).select("node")
