"""Structured Streaming over edge events: windowed activity with late data, and degrees and core numbers kept current in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.maintenance import updated_cores
from ..operators.structure import add_edges, remove_edges


def windowed_activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window_start, event_type, n, total`` of a stream (or table) of events (ts, event_type, value)."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def degree_changes(deltas: DataFrame) -> DataFrame:
    """``node, change`` of a batch of edge deltas (op, u, v): +1 for each added edge, -1 for each deleted one."""
    sign = F.when(F.col("op") == "add", 1).otherwise(-1)
    return deltas.select(F.explode(F.array("u", "v")).alias("node"), sign.alias("c")).groupBy("node").agg(F.sum("c").alias("change"))


def maintain(stream: DataFrame, base: str, checkpoint: str):
    """Applies each micro-batch of deltas to the degree table at ``base``/<batch>; a batch that runs again writes the same folder again."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{base}/{number}")
        after = before.join(degree_changes(batch), "node", "full").select("node", (F.coalesce("degree", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("degree"))
        after.write.mode("overwrite").parquet(f"{base}/{number + 1}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def net_changes(edges: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Added and removed edges of a batch of deltas (at, op, u, v) against ``edges``: each edge's last delta counts, and one that changes nothing goes. Ends may come in either order; loops go."""
    last = Window.partitionBy("u", "v").orderBy(F.desc("at"), "op")
    pairs = deltas.filter("u <> v").select("at", "op", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    final = pairs.withColumn("r", F.row_number().over(last)).filter("r = 1")
    added = final.filter("op = 'add'").select("u", "v").join(edges, ["u", "v"], "left_anti")
    return added, final.filter("op = 'del'").select("u", "v").join(edges, ["u", "v"], "left_semi")


def latest(spark: SparkSession, base: str) -> int:
    """The newest version under ``base`` of ``maintain`` or ``maintain_cores``. Ask when the stream has ended: a version is there once its last table is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return max(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())


def maintain_cores(stream: DataFrame, base: str, checkpoint: str):
    """Applies each micro-batch of deltas (at, op, u, v) to the graph at ``base``/<batch>/edges (u < v) and its cores at ``base``/<batch>/cores.

    A batch reads one version and writes the next one, so a batch that runs again after a failure writes the same tables again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before, after = f"{base}/{number}", f"{base}/{number + 1}"
        edges = spark.read.parquet(f"{before}/edges")
        added, removed = net_changes(edges, batch.persist())
        add_edges(remove_edges(edges, removed), added).write.mode("overwrite").parquet(f"{after}/edges")
        cores = updated_cores(spark.read.parquet(f"{after}/edges"), spark.read.parquet(f"{before}/cores"), added, removed)
        cores.write.mode("overwrite").parquet(f"{after}/cores")
        batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
