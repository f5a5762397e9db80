"""Readers and writers of the text formats of graph datasets, all as tables with declared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.iterate import dealt, ranked


def canonical(pairs: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """``u, v`` with u < v, each undirected edge once; loops and nulls go."""
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    found = pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter((a != b) & a.isNotNull() & b.isNotNull())
    return dealt(found, pairs.count(), "u", "v").distinct()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value``: trimmed lines that are neither blank nor comments, numbered from 0 in file order; of several files, in the order of their names.

    Spark reads large files first and packs small ones together, so the numbers come from names and byte ranges: counts per range, then a position inside it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_at", F.monotonically_increasing_id())
    kept = raw.withColumn("value", F.trim("value")).filter("value <> '' and not startswith(value, '#')")
    counts = kept.groupBy("_file", "_start").count()
    before = F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))  # one row for each byte range
    numbered = kept.join(F.broadcast(counts.select("_file", "_start", F.coalesce(before, F.lit(0)).alias("_before"))), ["_file", "_start"])
    return numbered.select((F.col("_before") + F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_at")) - 1).alias("line_no"), "value")


def _tokens(value="value"):
    return F.split(F.trim(F.col(value)), r"\s+")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).filter("trim(value) <> '' and not startswith(trim(value), '#')")
    return canonical(raw.select(_tokens()[0].cast("long").alias("u"), _tokens()[1].cast("long").alias("v")))


def read_members(spark: SparkSession, path: str, key: str = "community_id") -> DataFrame:
    """Lines of ids -> ``key`` (line number), ``pos``, ``node``; an id twice in a line counts once, at its first place."""
    members = lines(spark, path).select(F.col("line_no").alias(key), F.posexplode(_tokens()).alias("pos", "node"))
    return members.groupBy(key, F.col("node").cast("long").alias("node")).agg(F.min("pos").alias("pos")).select(key, "pos", "node")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter("trim(value) <> ''").select(_tokens()[0].cast("long").alias("id"), _tokens()[1].cast("double").alias("feat"))


def read_queries(spark: SparkSession, query_path: str, gt_path: str) -> tuple[DataFrame, DataFrame]:
    """Queries and ground truths, paired by line number."""
    return read_members(spark, query_path, "query_id"), read_members(spark, gt_path, "query_id").select("query_id", "node")


def read_snap(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A raw edge list -> edges over dense ids and ``id, old_id``; ids go by first appearance in the file."""
    pairs = lines(spark, path).select("line_no", _tokens()[0].cast("long").alias("a"), _tokens()[1].cast("long").alias("b"))
    seen = pairs.select(F.col("a").alias("old_id"), (2 * F.col("line_no")).alias("at")).unionByName(pairs.select(F.col("b").alias("old_id"), (2 * F.col("line_no") + 1).alias("at")))
    ids = dense_ids(seen.groupBy("old_id").agg(F.min("at").alias("at")), "at")
    one, two = ids.select(F.col("old_id").alias("a"), F.col("id").alias("u")), ids.select(F.col("old_id").alias("b"), F.col("id").alias("v"))
    return canonical(pairs.join(one, "a").join(two, "b")), ids


def dense_ids(vertices: DataFrame, order: str = "old_id") -> DataFrame:
    """``id, old_id``: 0, 1, ... in the given order, by counts of range partitions."""
    return ranked(vertices, order).select(F.col("_rank").alias("id"), "old_id")


def read_email_communities(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Lines of (node, class) -> ``community_id, node``; with ``ids``, unknown nodes go."""
    rows = lines(spark, path).select(_tokens()[1].cast("long").alias("community_id"), _tokens()[0].cast("long").alias("node"))
    if ids is None:
        return rows.distinct()
    return rows.join(ids.select(F.col("old_id").alias("node"), "id"), "node").select("community_id", F.col("id").alias("node")).distinct()


def read_snap_communities(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Lines of raw ids -> ``community_id, node`` over dense ids; raw ids that ``ids`` (id, old_id) doesn't know go."""
    raw = read_members(spark, path).withColumnRenamed("node", "old_id")
    return raw.join(ids, "old_id").select("community_id", F.col("id").alias("node"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``id, feat``: rows of a two-dimensional .npy file (one task reads one file)."""
    import io

    import numpy as np
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                matrix = np.load(io.BytesIO(blob), allow_pickle=False)
                for i in range(0, len(matrix), 4096):
                    part = matrix[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(part.astype(float).tolist(), pa.list_(pa.float64()))], names=["id", "feat"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "id long, feat array<double>")


def mapped_queries(queries: DataFrame, truth: DataFrame, ids: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and truths by dense id, the first ``limit`` queries. A query keeps only vertices that ``ids`` knows and goes when it has none left."""
    if limit is not None:
        queries, truth = queries.filter(F.col("query_id") < limit), truth.filter(F.col("query_id") < limit)
    if ids is not None:
        known = ids.select(F.col("old_id").alias("node"), "id")
        queries = queries.join(known, "node").drop("node").withColumnRenamed("id", "node")
        truth = truth.join(known, "node").drop("node").withColumnRenamed("id", "node")
        truth = truth.join(queries.select("query_id").distinct(), "query_id", "left_semi")
    return queries, truth


def read_splits(spark: SparkSession, folder: str, prefix: str = "1_induct", splits=("train", "valid", "test"), ids: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and truths of all splits in two tables, each with ``split``."""
    queries = truths = None
    for split in splits:
        q, t = read_queries(spark, f"{folder}/{prefix}_{split}_query", f"{folder}/{prefix}_{split}_gt")
        q, t = mapped_queries(q, t, ids, limit)
        q, t = q.withColumn("split", F.lit(split)), t.withColumn("split", F.lit(split))
        queries, truths = (q, t) if queries is None else (queries.unionByName(q), truths.unionByName(t))
    return queries, truths


STATS = "dataset string, community string, size long, inner_edges long, density double"


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=STATS)


RESULTS = T.StructType([T.StructField(n, T.StringType()) for n in ("dataset", "method", "query", "thr")] + [T.StructField(n, T.DoubleType()) for n in ("f1", "pre", "rec", "jac", "nmi", "ari", "avg_degree", "density", "size", "diameter", "conductance", "modularity", "density_modularity", "local_modularity", "subgraph_modularity", "edge_surplus", "time")])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows from CSV with declared columns; queries stay text."""
    return spark.read.csv(path, header=True, schema=RESULTS)


def write_members(members: DataFrame, path: str, key: str = "community_id", order: str = "node") -> None:
    """One line of ids for each key, in key order."""
    grouped = members.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), "node"))).alias("m"))
    grouped.orderBy(key).select(F.array_join(F.transform("m", lambda x: x["node"].cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.orderBy("u", "v").select(F.concat_ws(" ", "u", "v").alias("value")).write.mode("overwrite").text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """Statistics of communities as CSV, one folder for each dataset; ``read_stats`` of the parent reads them together."""
    stats.select(*[F.col(f.split()[0]) for f in STATS.split(", ")]).withColumn("part", F.col("dataset")).write.mode("overwrite").partitionBy("part").csv(path, header=True)


def append_rows(rows: DataFrame, path: str) -> None:
    """Rows of a run summary or a training log are added to what ``path`` holds; doubles keep 6 digits."""
    doubles = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.DoubleType)]
    rows.withColumns({c: F.round(c, 6) for c in doubles}).write.mode("append").parquet(path)


def append_members(members: DataFrame, path: str, key: str = "community_id") -> None:
    """Adds one line of sorted ids for each key."""
    grouped = members.groupBy(key).agg(F.array_sort(F.collect_set("node")).alias("m"))
    grouped.select(F.array_join(F.transform("m", lambda x: x.cast("string")), " ").alias("value")).write.mode("append").text(path)


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Metrics rounded to 6 digits, peak memory never below 0, as CSV with a header."""
    doubles = [f.name for f in results.schema.fields if isinstance(f.dataType, T.DoubleType)]
    out = results.withColumns({c: F.round(c, 6) for c in doubles})
    if "cpu_memory" in out.columns:
        out = out.withColumn("cpu_memory", F.greatest("cpu_memory", F.lit(0.0)))
    out.write.mode(mode).csv(path, header=True)
