"""Contiguous shards of nearly equal bytes, by prefix sums over the whole table (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix import prefix_sums


def contiguous_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, size in bytes (text and a terminator), checksum, shard and slot.

    In the order of (id, checksum, size), with nulls first, the byte range of the whole table is cut at equal targets:
    a row belongs to the shard in which the middle of its own byte range lies, so each shard is within one row of the
    target at either end. Slots count from 0 without gaps in the same order.

    Null text: size 1, checksum 0. Equal ids or wholly equal rows: neighbours, each with its own slot. Empty table: no rows.
    Other columns of ``docs`` play no part. Only (id, size, checksum) are shuffled, never the texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = prefix_sums(sized, [], ["doc_id", "text_crc32", "size"], "size")
    total = placed.agg(F.max(F.col("_before") + F.col("size"))).first()[0] or 1
    placed = placed.withColumn("shard", F.expr(f"int((2 * _before + size) * {n_shards} div {2 * total})"))
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # n_shards rows at most
        "doc_id", "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot")
    )


N_SHARDS = 8


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(contiguous_shards(docs, N_SHARDS))


def digest(shards: DataFrame) -> DataFrame:
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no CRC-32; it is folded here over the bytes of the text with the usual reflected polynomial.
ORACLE = """
WITH RECURSIVE folded(i, v, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM folded WHERE k < 8
),
tab AS (SELECT list(v ORDER BY i) AS t FROM folded WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
c AS (
  SELECT doc_id, size::BIGINT AS size,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, tab
),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS i, sum(size) OVER () AS total FROM c
),
s AS (SELECT *, ((2 * before + size) * 8 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (i - min(i) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
