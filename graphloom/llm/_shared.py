"""Helpers that every operator of this subpackage uses: a shared folder for cut lineage, and rows packed so that no column name clashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
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


def stored(df: DataFrame, tag: str, arrow_rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends there, and any executor can read it after another is lost.

    ``arrow_rows``: rows of long texts that go to Python at once while it is written, so that a batch stays small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(arrow_rows or before))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, beside which an operator's own columns may have any names; ``row.*`` brings them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def id_type(docs: DataFrame, id_col: str = "doc_id") -> str:
    return docs.schema[id_col].dataType.simpleString()


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
