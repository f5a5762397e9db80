"""Fixpoints of DataFrames: each round is written to the shared folder, so a lost executor costs a task, not the history."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, as in local tests, a temporary one is set; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, tag: str = "round") -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """``df`` for a join: sent to all tasks if it has ``most`` rows at most, else shuffled. Files of sorted ids are so small that Spark's own bound on their bytes would send millions."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows that one task takes at a time.
ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows by the hash of ``keys``, over as many tasks as keep each at ``ROWS``. Spark's own count is fixed, and it merges tasks by
    compressed bytes, so that a task's memory would grow with the input."""
    spark = df.sparkSession
    return df.repartition(max(-(-rows // ROWS), min(parallelism(spark), spark.sparkContext.defaultParallelism)), *keys)


def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``_rank`` 0, 1, ... in the given order: a position inside each range partition, and the counts of the partitions before it."""
    keys = {f"_o{i}": o if not isinstance(o, str) else F.col(o) for i, o in enumerate(order)}
    ranged = stored(df.withColumns(keys).repartitionByRange(parallelism(df.sparkSession), *keys).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("_part").count()
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + inside - 1).drop("_part", "_before", *keys)  # one row for each partition


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str, limit: int = 10_000) -> DataFrame:
    """Applies ``step`` until no row satisfies the condition ``changed``; the columns of ``state`` are those of the result.

    ``step`` returns the new state and whatever columns ``changed`` needs. Beyond ``limit`` rounds it is an error, never a silent cut.
    """
    state = stored(state)
    columns = state.columns
    for _ in range(limit):
        after = stored(step(state))
        moved = not after.filter(changed).isEmpty()
        discard(state)
        state = after.select(*columns)
        if not moved:
            return state
    raise RuntimeError(f"no fixpoint after {limit} rounds")
