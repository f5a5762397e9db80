"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import packed
from .prefix import prefix_sums

#: Weights of the sources in code point order, repeating; the mix in words of all words; most times that a source is read.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Marks that lower a document's weight by their share of its characters, and the least weight.
NOISE, LEAST = "!*%&$#|", 0.05
SEED = "mix-1"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text):
    """Of the characters, those that are not marks of noise; ``LEAST`` at least; 1 for null or empty text."""
    clean = F.length(F.translate(text, NOISE, "")) / F.length(text)
    return F.coalesce(F.when(F.length(text) > 0, F.greatest(F.lit(LEAST), clean)), F.lit(1.0))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size) with ``target`` words and ``_rank``.

    Weights go to sources by code point, null last. Sharing out ``share`` of all words by weight, cutting at ``cap`` times a
    source's words and sharing the excess again ends where every uncut source has one level of words per unit of weight.
    Sorted by the level at which each would be cut, that level is found with one prefix sum. One row for each source.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cut", cap * F.col("source_size") / F.col("_w"))
    rising = everything.orderBy("_cut", "_rank")
    ranked = ranked.withColumns({
        "_at": F.row_number().over(rising),
        "_level": (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("_w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    ranked = ranked.withColumn("_uncut", F.min(F.when(F.col("_level") <= F.col("_cut"), F.col("_at"))).over(everything))
    ranked = ranked.withColumn("_level", F.max(F.when(F.col("_at") == F.col("_uncut"), F.col("_level"))).over(everything))
    target = F.when(F.col("_at") >= F.col("_uncut"), F.col("_w") * F.col("_level")).otherwise(F.col("source_size") * float(cap))
    return ranked.select("source", "source_size", target.cast("double").alias("target"), "_rank")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """Decisions, one row for each distinct (id, source, text): ``doc_id, source, text_md5, n_rows, size, source_size, target, times, more``.

    Every document of a source is taken whole as often as its target holds complete epochs. The rest of the target goes to
    the documents with the smallest exponential keys -ln(u) / weight, u from a hash of seed, id and text: in key order, a
    document is taken once more while the middle of its words lies within the rest, so the total ends within half a
    document of the target and reruns agree. Wholly equal rows share one key and are neighbours in that order: all are taken ``times``
    times, and ``more`` of the ``n_rows`` once more, so that a group of any size may lie across the end of the rest.

    Null or empty text: size 0, taken as often as falls to it, adds no words. Null source: a source of its own, last.
    Null id: hashed as such. Empty table: no rows. Other columns play no part; only sizes and keys are shuffled.
    """
    text = F.col(text_col)
    units = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_md5"), word_count(text).alias("size"), quality_weight(text).alias("_weight"))
        .groupBy("doc_id", "source", "text_md5", "size", "_weight")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    targets = source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size")))
    digest = F.md5(F.encode(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_md5"), "UTF-8"))
    chance = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    keyed = units.withColumns({"_key": -F.log(chance) / F.col("_weight"), "_words": F.col("size") * F.col("n_rows")})
    named = keyed.withColumnRenamed("source", "_source").join(targets, F.col("_source").eqNullSafe(F.col("source"))).drop("_source", "_weight")
    summed = prefix_sums(named, ["_rank"], ["_key", "doc_id", "text_md5"], "_words")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    fits = F.when(F.col("size") > 0, F.floor((rest - F.col("_before")) / F.col("size") + 0.5)).otherwise(F.when(F.col("_before") <= rest, F.col("n_rows")).otherwise(F.lit(0)))
    more = F.greatest(F.lit(0), F.least(fits, F.col("n_rows"))).cast("long")
    return (
        summed.withColumn("_epochs", epochs.cast("long"))
        .withColumn("more", F.when(F.col("_epochs") < CAP, more).otherwise(F.lit(0).cast("long")))
        .select("doc_id", "source", "text_md5", "n_rows", "size", "source_size", "target", F.col("_epochs").alias("times"), "more")
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` themselves, all columns, each as often as ``mix`` takes it.

    Of wholly equal (id, source, text) rows only those of one unit of each source, at the end of its rest, are not all taken alike; such
    rows are numbered by prefix sums, whatever else their columns hold.
    """
    plan = mix(docs).filter("times > 0 or more > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_md5").alias("_md5"), "n_rows", "times", "more")
    hashed = docs.select(packed(docs), F.col("doc_id").alias("id"), F.col("source").alias("source"), F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("md5"))
    on = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("md5") == F.col("_md5"))
    taken = hashed.join(plan, on).select("row", "_md5", "n_rows", "times", "more")
    alike = taken.filter("more = 0 or more = n_rows").select("row", (F.col("times") + (F.col("more") > 0).cast("long")).alias("times"))
    across = prefix_sums(taken.filter("more > 0 and more < n_rows").withColumn("one", F.lit(1)), ["_md5", "more"], [], "one")
    across = across.select("row", (F.col("times") + (F.col("_index") < F.col("more")).cast("long")).alias("times")).filter("times > 0")
    return alike.unionByName(across).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = plan.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    times = F.col("times") + (F.col("_row") <= F.col("more")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CASE WHEN length(text) > 0 THEN greatest({LEAST}::DOUBLE, length(translate(text, '{NOISE}', '')) / length(text)) ELSE 1.0::DOUBLE END AS weight
  FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(rank % 3 + 1)::INT] AS w FROM r),
c AS (SELECT *, 2 * source_size / w AS cut FROM w),
l AS (
  SELECT *, row_number() OVER (ORDER BY cut, rank) AS pos,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY cut, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cut, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
),
u AS (SELECT *, min(CASE WHEN level <= cut THEN pos END) OVER () AS uncut FROM l),
v AS (SELECT *, max(CASE WHEN pos = uncut THEN level END) OVER () AS flat FROM u),
t AS (SELECT source, source_size, rank, CASE WHEN pos >= uncut THEN w * flat ELSE source_size * 2.0::DOUBLE END AS target FROM v),
k AS (
  SELECT d.doc_id, d.size, d.text_md5, t.*, -ln((('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || text_md5), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id, text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN epochs < 2 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM e
"""
