"""SimHash near-duplicates: exact comparison of fingerprint tiles with numpy exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import packed, stored
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: A tile holds fingerprints whose four 16-bit quarters have the same population counts, about this many.
TILE = 2048
#: Tile pairs in one batch of a task, at 16 bytes for each fingerprint of a tile.
PAIRS = 1024
QUARTERS = 4


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of ``text`` as a signed number; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space 09-0D and 20 only
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :][:n].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    pairs = list(zip(starts[:n].tolist(), last))
    for at in range(0, n, 1 << 14):
        h = np.array([digest(flat[a:b], SEED) for a, b in pairs[at : at + (1 << 14)]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def _stars(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Of two tiles, each linked fingerprint with the least one that it reaches inside the two: their components as stars."""
    at, to = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    if not len(at):
        return []
    values, ids = np.unique(np.concatenate([a[at], b[to]]), return_inverse=True)
    x, y = ids[: len(at)], ids[len(at) :]
    label = np.arange(len(values))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, new[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(values))
    return list(zip(values[own].view(np.int64).tolist(), values[label[own]].view(np.int64).tolist()))


def _offsets(radius: int) -> list[int]:
    """Steps from a cell to itself and to half of the cells whose population counts, summed over quarters, differ by ``radius`` at most."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, s)) <= radius and s >= (0,) * QUARTERS]
    return [sum(x * 32**i for i, x in enumerate(s)) for s in steps]


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that connect the same groups as all pairs of different ``fp`` within ``radius`` bits do.

    Fingerprints are tiled by the population counts of their quarters. Two that differ in r bits have counts that differ by r
    at most in sum, so tile pairs beyond the radius are skipped without loss; every other tile pair is compared in full
    by exclusive-or and bit count. Of the links found in a tile pair only a star for each of its components leaves the task:
    fewer rows than fingerprints, however many copies a group has.
    """
    bits = 64 // QUARTERS
    cell = sum((F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND(F.lit((1 << bits) - 1))) + 4) * 32**i for i in range(QUARTERS))
    prints = prints.select("fp").distinct().withColumn("cell", cell.cast("int"))
    counts = prints.groupBy("cell").count().withColumn("parts", F.ceil(F.col("count") / TILE)).select("cell", "parts")
    tiles = (
        prints.join(F.broadcast(counts), "cell")  # 17**4 cells at most
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy("cell", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stored(tiles, "tiles")
    near = tiles.select(F.col("part").alias("part_a"), F.col("fps").alias("fps_a"), F.col("cell").alias("cell_a"), F.explode(F.array(*[F.col("cell") + F.lit(o) for o in _offsets(radius)])).alias("cell"))
    near = near.join(F.broadcast(counts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))  # a full cell is dealt by its tiles
    near = near.filter((F.col("cell") != F.col("cell_a")) | (F.col("part_a") <= F.col("part")))
    pairs = near.join(tiles.select("cell", "part", F.col("fps").alias("fps_b")), ["cell", "part"]).select("fps_a", "fps_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in batch.columns:
                at = c.offsets.to_numpy()
                flat = c.values.to_numpy().view(np.uint64)
                sides.append([flat[i:j] for i, j in zip(at[:-1], at[1:])])
            found = [p for a, b in zip(*sides) for p in _stars(a, b, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return stored(pairs.mapInArrow(compare, "a long, b long"), "near", PAIRS)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, text_hash, fp, root, component_id, keeper``.

    ``component_id`` is the smallest id among all rows whose fingerprints are connected by steps of ``radius`` bits or fewer;
    ``keeper`` marks the rows with that id and the smallest text hash of them: one document of each group.
    Null, empty and blank texts have fingerprint 0 and link like any other. Null ids: never the smallest unless the whole
    group has none (component_id null). Wholly equal rows are all keepers together. Empty table: no rows.
    """
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("text"))
    firsts = prints.groupBy("fp").agg(F.min(rank).alias("first"))
    roots = stored(components(near_links(prints, radius)), "roots").withColumnRenamed("v", "fp")
    named = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    groups = named.select("fp", "root").join(best, "root")
    out = prints.join(groups, "fp")
    keeper = F.col("doc_id").eqNullSafe(F.col("best")["id"]) & (F.col("text_hash") == F.col("best")["text"])
    return out.select("doc_id", "text_hash", "fp", "root", F.col("best")["id"].alias("component_id"), keeper.alias("keeper"))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each near-duplicate group does. Of rows with equal id and text the one whose columns sort first as JSON stays."""
    kept = near_duplicates(docs, radius).filter("keeper").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("n"))
    kept = stored(kept, "kept")
    rows = docs.select(packed(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    joined = rows.join(kept, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    again = joined.filter("n > 1").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return joined.filter("n = 1").select("row.*").unionByName(again.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
