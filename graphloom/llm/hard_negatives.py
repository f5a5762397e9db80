"""Hard negatives for retrieval training: exact integer inner products, found through an orthogonal rotation whose leading components decide early."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import discard, shared_folder, stored
from .prefix import prefix_sums

#: Components after which a pair may be discarded.
CUTS = (8, 16, 32)
#: Values of anchors in one block (so in one broadcast, 8 bytes each), and its anchors at most; rows that meet a block at once; pairs verified at once.
BLOCK_VALUES, BLOCK_ANCHORS, ROWS, PAIRS = 1 << 20, 4096, 512, 1 << 16
#: Values of the rows from which the rotation is fitted. It only decides how early a pair goes, never which pairs are found.
FIT_VALUES = 1 << 20
#: Share of the norms' product that rounding may take, for each component: float64 holds 16 digits.
SLACK = 1e-12
_TOP = (1 << 63) - 1


@dataclass
class Side:
    """Rows of whole numbers with their rotated components and, for each cut, the norms of what lies beyond it."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    rotated: np.ndarray
    tails: list[np.ndarray]
    norms: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, rotation: np.ndarray) -> Side:
        rotated = whole @ rotation
        beyond = [np.sqrt(np.square(rotated[:, cut:]).sum(axis=1)) for cut in CUTS if cut < rotated.shape[1]]
        return cls(ids, labels, whole, rotated, beyond, np.sqrt(np.square(whole).sum(axis=1)))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two matrices of whole numbers; beyond 64 bits the largest or smallest long stands."""
    if not len(x) or float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1]) < 2.0**62:
        return np.einsum("ij,ij->i", x.astype(np.int64), y.astype(np.int64))
    exact = (sum(int(p) * int(q) for p, q in zip(a, b)) for a, b in zip(x.tolist(), y.tolist()))
    return np.fromiter((max(-_TOP, min(_TOP, s)) for s in exact), np.int64, len(x))


def survivors(rows: Side, anchors: Side, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, anchor, score`` of the ``asked`` pairs whose integer product lies between the anchor's bounds, both included.

    Products of leading components accumulate cut by cut. What the others can add is at most the product of both remainders' norms (Cauchy-Schwarz) plus
    the slack for rounding, so a pair that leaves the bounds by more goes; those that stay to the end are verified with whole numbers.
    """
    slack = SLACK * (rows.whole.shape[1] + 1)
    least, most = np.where(low <= -_TOP, -np.inf, low), np.where(high >= _TOP, np.inf, high)  # the longs at either end stand for all beyond
    if rows.tails:
        part = rows.rotated[:, : CUTS[0]] @ anchors.rotated[:, : CUTS[0]].T
        rest = np.outer(rows.tails[0], anchors.tails[0]) + np.outer(slack * rows.norms, anchors.norms)
        asked = asked & (part + rest >= least) & (part - rest <= most)
    i, j = np.nonzero(asked)
    found = []
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        if rows.tails:
            sofar = part[a, b]
            for k, (before, cut) in enumerate(zip(CUTS, CUTS[1 : len(rows.tails)]), 1):
                sofar = sofar + np.einsum("ij,ij->i", rows.rotated[a, before:cut], anchors.rotated[b, before:cut])
                rest = rows.tails[k][a] * anchors.tails[k][b] + slack * rows.norms[a] * anchors.norms[b]
                stay = (sofar + rest >= least[b]) & (sofar - rest <= most[b])
                a, b, sofar = a[stay], b[stay], sofar[stay]
        score = products(rows.whole[a], anchors.whole[b])
        stay = (score >= low[b]) & (score <= high[b])
        found.append((a[stay], b[stay], score[stay]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([f[k] for f in found] or [none]) for k in range(3))


class Best:
    """The first ``most`` (score downwards, then id) for each of many slots; ``least`` is what a further one must reach."""

    def __init__(self, slots: int, most: int):
        self.most, self.least = most, np.full(slots, -_TOP)
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.isin(self.kept[0], slot)
        others = tuple(x[~touched] for x in self.kept)
        slot, score, ids = (np.concatenate(x) for x in zip((x[touched] for x in self.kept), (slot, score, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        last = place == self.most - 1
        self.least[slot[last]] = score[last]
        self.kept = tuple(np.concatenate([o, x[place < self.most]]) for o, x in zip(others, (slot, score, ids)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``vec_id, label, whole``: of the rows that take part, the vector times ``scale``, floored."""
    x = F.col(vector_col).cast("array<double>")
    ok = lambda y: F.coalesce(F.abs(y * scale) < float("inf"), F.lit(False))  # noqa: E731  NaN is above all numbers
    floored = F.transform(x, lambda y: F.when(F.abs(y * scale) < 2.0**53, F.floor(y * scale).cast("double")).otherwise(y * scale))
    known = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, ok))
    return known.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), floored.alias("whole"))


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes (not centred, as inner products aren't) of the rows with the least hashes of their ids, ``FIT_VALUES`` values at most; columns by falling share."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, FIT_VALUES // max(1, width))).select("whole").toArrow()
    x = _matrix(sample.column(0).combine_chunks(), width) if sample.num_rows else np.zeros((1, width))
    x = x / max(1.0, float(np.abs(x).max(initial=0)))
    _, axes = np.linalg.eigh(x.T @ x)
    return axes[:, ::-1].copy()


def hard_negatives(
    vectors: DataFrame, anchors_every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``anchors_every``; scores are integer inner products of the vectors times ``scale``, floored. An anchor's
    positives are its first ``positives`` other rows of its label, by falling score, then id; for each, the first ``negatives`` rows of other labels whose
    score is ``low`` to ``high`` per cent of the positive's.

    Anchors are searched in blocks of bounded size: a block is broadcast and met by all rows in two passes, positives first, then negatives between the bounds
    that the positives give. A task keeps a few rows for each anchor, and these few are ranked by anchor. Rows are never dealt by label, so a frequent label is no hot key.

    Rows with a null id, label, vector or component, or a component that is not finite (also after scaling), take no part. Labels are whole numbers. Shorter
    vectors end in zeros. Scores beyond 64 bits stand at the largest or smallest long. Repeated rows count each; rows that share the anchor's id are
    neither its positives nor its negatives, and each of several anchor rows of one id has its own results. Empty table: no rows. Other columns play no part.
    """
    spark = vectors.sparkSession
    known = stored(whole_vectors(vectors, scale, id_col, label_col, vector_col), "vectors")
    width = known.agg(F.max(F.size("whole"))).first()[0] or 0
    axes = rotation(known, width)
    asked = known.filter(F.col("vec_id") % anchors_every == 0)
    anchors = stored(prefix_sums(asked.withColumn("_one", F.lit(1)), [], ["vec_id", "label"], "_one").select(F.col("_index").alias("no"), "vec_id", "label", "whole"), "anchors")
    size = max(1, min(BLOCK_ANCHORS, BLOCK_VALUES // max(1, width)))
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n_anchors = anchors.count()
    for first in range(0, n_anchors, size):
        block = anchors.filter(F.col("no").between(first, first + size - 1)).orderBy("no").select("vec_id", "label", "whole").toArrow()
        near = _near(known, block, axes, positives)
        _far(known, block, axes, near, negatives, low, high).write.parquet(f"{folder}/block={first}")
    discard(known)
    discard(anchors)
    return spark.read.schema(f"{kind}, block long").parquet(folder).drop("block") if n_anchors else spark.createDataFrame([], kind)


def _side(batch: pa.RecordBatch | pa.Table, axes: np.ndarray) -> Side:
    ids, labels, whole = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns)
    return Side.of(ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False), _matrix(whole, len(axes)), axes)


def _slices(batches: Iterator[pa.RecordBatch], axes: np.ndarray) -> Iterator[Side]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _side(batch.slice(at, ROWS), axes)


def _near(known: DataFrame, block: pa.Table, axes: np.ndarray, most: int) -> list:
    """``no, place, vec_id, score`` of the positives of one block's anchors: ``most`` for each."""
    shipped = known.sparkSession.sparkContext.broadcast((block, axes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, turn = shipped.value
        anchors = _side(table, turn)
        best, top = Best(len(anchors.ids), most), np.full(len(anchors.ids), _TOP)
        for rows in _slices(batches, turn):
            same = (rows.labels[:, None] == anchors.labels) & (rows.ids[:, None] != anchors.ids)
            i, j, score = survivors(rows, anchors, same, best.least, top)
            best.add(j, score, rows.ids[i])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.kept], names=["no", "score", "vec_id"])

    order = Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")
    found = known.mapInArrow(search, "no long, score long, vec_id long").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return found.collect()  # ``most`` rows for each anchor of the block


def _far(known: DataFrame, block: pa.Table, axes: np.ndarray, near: list, most: int, low: int, high: int) -> DataFrame:
    """The rows of ``hard_negatives`` for one block of anchors whose positives are ``near``."""
    places = max([r.place for r in near], default=1)
    ids, scores = np.zeros((block.num_rows, places), np.int64), np.zeros((block.num_rows, places), np.int64)
    lowest, highest = np.full(ids.shape, _TOP), np.full(ids.shape, -_TOP)
    for r in near:
        at = (r.no, r.place - 1)
        ids[at], scores[at], lowest[at], highest[at] = r.vec_id, r.score, -(-low * r.score // 100), high * r.score // 100
    shipped = known.sparkSession.sparkContext.broadcast((block, axes, ids, scores, lowest, highest))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, turn, ids, scores, lowest, highest = shipped.value
        anchors = _side(table, turn)
        best = Best(ids.size, most)
        for rows in _slices(batches, turn):
            bar = np.maximum(lowest, best.least.reshape(ids.shape))
            other = (rows.labels[:, None] != anchors.labels) & (rows.ids[:, None] != anchors.ids)
            i, j, score = survivors(rows, anchors, other, bar.min(axis=1), highest.max(axis=1))
            pair, place = np.nonzero((score[:, None] >= bar[j]) & (score[:, None] <= highest[j]))
            best.add(j[pair] * ids.shape[1] + place, score[pair], rows.ids[i[pair]])
        slot, score, found = best.kept
        no, place = np.divmod(slot, ids.shape[1])
        columns = {"no": no, "place": place, "anchor_id": anchors.ids[no], "positive_id": ids[no, place], "negative_id": found, "positive_score": scores[no, place], "negative_score": score}
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], names=list(columns))

    order = Window.partitionBy("no", "place").orderBy(F.desc("negative_score"), "negative_id")
    kind = "no long, place long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    ranked = known.mapInArrow(search, kind).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 move on by one first."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    return hard_negatives(vectors.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.w, b.w)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
