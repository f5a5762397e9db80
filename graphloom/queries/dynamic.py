"""Cores kept current under deltas (as a table and as a stream), diameters, masks by removals, path weights, set encodings and singular vectors, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import maintenance, metrics, prep, recommend, structure
from ..plans.iterate import shared_folder, stored
from ..sources import derived as D
from ..streaming import degrees as stream
from .structural import _DEG, _cores, _r

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_E1, _E2, _A, _B = D.SQL_COPART, D.SQL_COPART2, D.SQL_ADJ, D.SQL_BRANDS

_CHANGED = f"""WITH {_E2.replace("e AS MATERIALIZED", "o AS MATERIALIZED")}, e AS MATERIALIZED (SELECT u, v FROM o WHERE (u + v) % 5 <> 0 UNION SELECT u, v + 1 FROM o WHERE (u * 3 + v) % 7 = 0 AND (u, v + 1) NOT IN (SELECT u, v FROM o)),
{_A}, {_cores(16)}, n AS (SELECT u AS node FROM o UNION SELECT v FROM o UNION SELECT s FROM adj) SELECT node, coalesce(core, 0) AS core FROM n LEFT JOIN core USING (node)"""


def _deltas(edges):
    """Edges to remove and to add, none of which is both."""
    removed = edges.filter("(u + v) % 5 = 0")
    added = edges.filter("(u * 3 + v) % 7 = 0").select("u", (F.col("v") + 1).alias("v")).join(edges, ["u", "v"], "left_anti")
    return added, removed


@query("core_update", _CHANGED)
def core_update(spark, d):
    edges = D.copart2(spark, d)
    added, removed = (stored(x, "delta") for x in _deltas(edges))
    after = structure.add_edges(structure.remove_edges(edges, removed), added)
    return maintenance.updated_cores(stored(after, "after"), structure.core_numbers(edges), added, removed)


@query("core_stream", _CHANGED)
def core_stream(spark, d):
    """The same deltas as a stream of files, two micro-batches of them."""
    base, path = (f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}" for name in ("cores", "deltas"))
    edges = D.copart2(spark, d)
    edges.write.parquet(f"{base}/0/edges")
    structure.core_numbers(edges).write.parquet(f"{base}/0/cores")
    added, removed = _deltas(edges)
    rows = added.withColumn("op", F.lit("add")).unionByName(removed.withColumn("op", F.lit("del"))).select(F.lit(1).alias("at"), "op", "u", "v")
    rows.repartition(2, "u", "v").write.parquet(path)
    source = spark.readStream.schema("at int, op string, u long, v long").option("maxFilesPerTrigger", 1).parquet(path)
    stream.maintain_cores(source, base, f"{base}-log").awaitTermination()
    return spark.read.parquet(f"{base}/{stream.latest(spark, base)}/cores")


_INNER = "i AS MATERIALIZED (SELECT a.community, e.s, e.d FROM adj e JOIN c a ON e.s = a.node JOIN c b ON e.d = b.node AND a.community = b.community)"


@query("set_diameters", f"""WITH RECURSIVE {_E1}, {_A}, {_B}, {_INNER}, r AS (SELECT community, node AS root, node, 0 AS dist FROM c UNION SELECT r.community, root, i.d, dist + 1 FROM r JOIN i ON r.community = i.community AND r.node = i.s WHERE dist < 20),
m AS (SELECT community, root, node, min(dist) AS dist FROM r GROUP BY ALL), n AS (SELECT community, count(*) AS n FROM c GROUP BY 1)
SELECT community, CASE WHEN count(*) = max(n) * max(n) THEN max(dist)::DOUBLE ELSE 'inf'::DOUBLE END AS diameter FROM m JOIN n USING (community) GROUP BY community""")
def set_diameters(spark, d):
    return metrics.diameters(stored(D.copart(spark, d), "copart"), D.brands(spark, d))


@query("removal_masks", f"""WITH RECURSIVE {_E1}, {_A}, {_B}, {_INNER}, h AS MATERIALIZED (SELECT community, node, md5(concat_ws('|', '0', community, node)) AS h FROM c),
part AS (SELECT community, node AS root, node FROM c UNION SELECT p.community, root, i.d FROM part p JOIN i ON p.community = i.community AND p.node = i.s),
start AS (SELECT p.community, p.root AS node, any_value(a.h) AS h FROM part p JOIN h a ON p.root = a.node JOIN h b ON p.node = b.node GROUP BY 1, 2 HAVING min(b.h) = any_value(a.h)),
reach AS (SELECT s.community, t.h AS pass, s.node FROM start s JOIN part p ON p.root = s.node JOIN h t ON t.node = p.node UNION SELECT r.community, r.pass, i.d FROM reach r JOIN i ON r.community = i.community AND r.node = i.s JOIN h x ON x.node = i.d WHERE x.h <= r.pass),
g AS MATERIALIZED (SELECT community, node, min(pass) AS pass FROM reach GROUP BY 1, 2),
w AS (SELECT g.community, g.node, g.pass, 0 AS steps FROM g JOIN h USING (node) WHERE h.h = g.pass UNION SELECT w.community, i.d, w.pass, steps + 1 FROM w JOIN i ON w.community = i.community AND w.node = i.s JOIN g ON g.node = i.d AND g.pass = w.pass WHERE steps < 30),
k AS (SELECT community, node, pass, min(steps) AS steps FROM w GROUP BY ALL)
SELECT community, node FROM k QUALIFY row_number() OVER (PARTITION BY community ORDER BY pass, steps, node) <= 10""".replace("part AS (SELECT", "joined AS (SELECT", 1).replace("FROM part p", "FROM joined p").replace("JOIN part p", "JOIN joined p"))
def removal_masks(spark, d):
    return prep.masked_by_removals(stored(D.copart(spark, d), "copart"), D.brands(spark, d), 10)


_WEIGHTS = "w AS (SELECT s, d, 1.0::DOUBLE / sqrt(a.degree * b.degree::DOUBLE) AS w FROM adj JOIN g a ON s = a.node JOIN g b ON d = b.node)"
_SPREAD = "x1 AS (SELECT s AS node, 1 AS hop, j, sum(w * x) AS x FROM w JOIN x0 ON d = x0.node GROUP BY ALL) SELECT node, hop, j, round(x, 9) AS x FROM (FROM x0 UNION ALL FROM x1)"


@query("path_augmentation", f"""WITH {_E2}, {_A}, {_DEG}, {_WEIGHTS}, {D.SQL_QUERIES}, p0 AS (SELECT node AS j, node FROM q), {', '.join(f'p{i} AS (SELECT DISTINCT j, d AS node FROM p{i - 1} JOIN adj ON node = s)' for i in (1, 2, 3))},
x0 AS (SELECT node, 0 AS hop, j, 1.0::DOUBLE / (1 + min(far)) AS x FROM ({' UNION ALL '.join(f'SELECT j, node, {i} AS far FROM p{i}' for i in range(4))}) GROUP BY node, j), {_SPREAD}""")
def path_augmentation(spark, d):
    edges = D.copart2(spark, d)
    return structure.propagate(edges, prep.path_weights(edges, D.brand_queries(spark, d)), 1).withColumn("x", _r("x"))


@query("set_encodings", f"WITH {_E2}, {_A}, {_DEG}, {_WEIGHTS}, x0 AS (SELECT p_partkey AS node, 0 AS hop, p_brand AS j, 1.0::DOUBLE AS x FROM part), {_SPREAD}")
def set_encodings(spark, d):
    return structure.propagate(D.copart2(spark, d), prep.set_encodings(D.brands(spark, d).withColumnRenamed("community", "j")), 1).withColumn("x", _r("x"))


@query("singular_features")
def singular_features(spark, d):
    """Eight singular components of the quantities of parts by supplier."""
    cells = D.table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("j"), F.col("l_quantity").cast("double").alias("x"))
    return recommend.truncated(cells, 8)
