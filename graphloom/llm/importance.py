"""Importance resampling towards a target collection: hashed word runs, log ratios of their bucket counts, and a Gumbel draw without replacement."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import utf8
from ._shared import discard, id_type, stored
from .prefix import prefix_sums

#: Words of UTF-8 bytes after A-Z became a-z: every byte of a character beyond ASCII is 0x80 or more.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Shortest and longest run of words, buckets (their table is broadcast, so this bounds it), least words of a document that may be drawn, per cent drawn, seed.
SHORTEST, LONGEST, BUCKETS, LEAST_WORDS, PER_CENT, SEED = 1, 1, 10_000, 20, 10, 2024
#: Rows of texts that go to Python at once.
ARROW_ROWS = 500


def ring_buckets(raw: bytes, shortest: int = SHORTEST, longest: int = LONGEST, n_buckets: int = BUCKETS) -> tuple[int, array]:
    """Number of words, and the bucket of every run of ``shortest`` to ``longest`` consecutive words, repeats included.

    One scan. The ring holds the CRC-32 states of the runs that started at the last ``longest`` words, oldest first; each word extends every state by a
    space and itself and starts a new one, so no run is ever put together as a string.
    """
    ring: list[int] = []
    out, n_words = array("I"), 0
    for m in _WORD.finditer(raw.lower()):
        word = m.group()
        n_words += 1
        if len(ring) == longest:
            del ring[0]
        if ring:
            further = b" " + word
            ring = [crc32(further, state) for state in ring]
        ring.append(crc32(word))
        for state in ring[: len(ring) - shortest + 1]:
            out.append(state % n_buckets)
    return n_words, out


def bucket_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, longest: int = LONGEST, n_buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, hits``: for each row its words, its word runs and how many of them fall into which bucket. Null text: none."""
    if not 1 <= shortest <= longest:
        raise ValueError("runs need 1 <= shortest <= longest")
    hit = pa.struct([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            words, features, buckets, counts = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                n, found = ring_buckets(raw[a:b].tobytes(), shortest, longest, n_buckets)
                which, how_many = np.unique(np.frombuffer(found, np.uint32), return_counts=True)
                words.append(n)
                features.append(len(found))
                buckets.append(which)
                counts.append(how_many)
            ends = np.cumsum([0, *map(len, buckets[1:])]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(buckets).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int64))], fields=list(hit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["doc_id", "n_words", "n_features", "hits"]
            )

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(count, f"doc_id {id_type(chosen)}, n_words long, n_features long, hits array<struct<bucket:int,n:long>>")


def totals(counted: DataFrame, name: str) -> DataFrame:
    """``bucket`` and its count over all rows: partial sums in every task, then one row a bucket."""
    return counted.select(F.explode("hits").alias("hit")).groupBy(F.col("hit.bucket").alias("bucket")).agg(F.sum("hit.n").alias(name))


def gains(of_docs: DataFrame, of_target: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain``: floored thousandths of the log ratio of smoothed shares, target over documents; one row for each bucket that either side holds."""
    both = of_docs.join(of_target, "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + n_buckets) / ((F.col("s") + 1) * (F.col("all_t") + n_buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row of sums


def weighed(counted: DataFrame, table: np.ndarray) -> DataFrame:
    """``counted`` with ``weight``, the sum of the gains of its word runs, in place of ``hits``."""
    shipped = counted.sparkSession.sparkContext.broadcast(table)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(3)
            flat, ends = hits.flatten(), np.cumsum(np.append(0, hits.value_lengths().to_numpy(zero_copy_only=False)))
            each = shipped.value[flat.field(0).to_numpy(zero_copy_only=False)] * flat.field(1).to_numpy(zero_copy_only=False)
            upto = np.append(0, np.cumsum(each))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((upto[ends[1:]] - upto[ends[:-1]]).astype(np.int64))], names=["doc_id", "n_words", "n_features", "weight"])

    return counted.mapInArrow(add, f"doc_id {id_type(counted)}, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", shortest: int = SHORTEST, longest: int = LONGEST,
    n_buckets: int = BUCKETS, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_features, weight, score, rank``.

    ``weight`` sums the gains of the row's word runs, ``score`` adds Gumbel noise drawn from the id, so that the highest scores are a sample without
    replacement in proportion to exp(weight / 1000). Of the N rows with ``least_words`` words or more, the floor(N * per_cent / 100) first by score, then id,
    get a ``rank`` from 1; all others have null. The texts are scanned once and the bucket counts stored; ranks come from prefix sums over range partitions.

    Null or empty text: no words, weight 0, never drawn. Null id: noise of the empty id, before all others among ties. Repeated rows: equal scores, each
    with a rank of its own. No target: gains come from the documents alone. Empty table: no rows. Other columns of either table play no part.
    """
    settings = dict(shortest=shortest, longest=longest, n_buckets=n_buckets)
    counted = stored(bucket_counts(docs, id_col, text_col, **settings), "buckets", ARROW_ROWS)
    wanted = target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text"))
    table = np.zeros(n_buckets, np.int64)
    for r in gains(totals(counted, "s"), totals(bucket_counts(wanted, **settings), "t"), n_buckets).collect():  # n_buckets rows at most
        table[r.bucket] = r.gain
    known = stored(weighed(counted, table), "weights")
    discard(counted)

    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8"), 256)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored = known.withColumn("score", F.col("weight") + noise.cast("long"))
    enough = F.col("n_words") >= least_words
    drawn = scored.filter(enough).count() * per_cent // 100
    placed = prefix_sums(scored.filter(enough).select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("_low")), [], ["_low", "doc_id"], "n_features")
    rank = F.when(F.col("_index") < drawn, F.col("_index") + 1).cast("long").alias("rank")
    chosen = placed.select("doc_id", "n_features", "weight", "score", rank)
    return chosen.unionByName(scored.filter(~enough).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 is folded over the bytes of each different word with the usual reflected polynomial.
ORACLE = r"""
WITH RECURSIVE folded(i, v, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM folded WHERE k < 8
),
tab AS (SELECT list(v ORDER BY i) AS t FROM folded WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
words AS (SELECT word FROM dw UNION SELECT word FROM bw),
hashed AS (
  SELECT word, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM words), tab
),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dw JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM bw JOIN hashed USING (word) GROUP BY 1),
st AS (SELECT bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, coalesce(sum(s) OVER (), 0) AS alls, coalesce(sum(t) OVER (), 0) AS allt FROM s FULL JOIN t USING (bucket)),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (alls + 10000) / ((s + 1) * (allt + 10000))))::BIGINT AS gain FROM st),
weight AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (r)
),
placed AS (
  SELECT *, n_features >= 20 AS enough, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS i,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND i <= n * 10 // 100 THEN i END AS rank FROM placed
"""
