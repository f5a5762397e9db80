"""Which labelled rows a model may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that a sample of labelled rows holds at most, whatever its number of rows.
SAMPLE_BYTES = 48 << 20


def held_out(doc_id) -> F.Column:
    """True for rows whose labels no model sees: CRC-32 of the id as text leaves 2 modulo 4. Null ids are held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(True))


def training_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, y`` of at most ``most`` labelled rows that may be learned from, those with the least hashes of their ids. Ids labelled twice count once, by their largest label."""
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``doc_id, text, y``: the sampled labels (``most`` rows, so broadcast) with the whole texts of their documents.

    An id with several rows stands for the least of their texts. The sample holds ``most_bytes`` of text at most: a text of more than an eighth of that is left
    out alone, and of the others those beyond the bound in the order of the ids' hashes. Where no text is that short, the shortest one stays.
    """
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(training_labels(labels, label, most)), "doc_id")
    one = chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sized = one.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_b"))
    every = Window.partitionBy(F.lit(0))  # ``most`` rows at most
    counted = F.when(F.col("_b") <= most_bytes // 8, F.col("_b")).otherwise(0)
    placed = sized.select(
        "doc_id", "_b", F.sum(counted).over(every.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("_upto"), F.row_number().over(every.orderBy("_b", F.xxhash64("doc_id"), "doc_id")).alias("_place")
    )
    fits = placed.filter((F.col("_b") <= most_bytes // 8) & (F.col("_upto") <= most_bytes) | (F.col("_place") == 1)).select("doc_id")
    return one.join(F.broadcast(fits), "doc_id").select("doc_id", "text", "y")
