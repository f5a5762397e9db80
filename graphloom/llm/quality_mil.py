"""Quality by attention-based multiple-instance learning: passages are encoded, weighted by gated attention, and the weighted sum is scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import Rolling, blocks, runs, separated, utf8
from ._labels import held_out, labelled_texts
from ._shared import id_type

#: Bytes of a passage, labelled documents to learn from at most, sizes of the layers, and passes over the sample.
PASSAGE, TRAIN_DOCS, HIDDEN, ATTENTION, EPOCHS = 512, 4000, 24, 12, 40
THRESHOLD = 0.7

# Classes of bytes. 0 lower case, 1 upper case, 2 digit, 3 space, 4 line feed, 5 comma or full stop, 6 multi-byte, 7 other
# control, then groups of marks.
_MARKS = ("!?", "\"'`", "()[]{}", "-_", ":;", "/\\|", "+=<>~^", "@#$%&*")
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[[44, 46]], _CLASS[128:] = 0, 1, 2, 3, 4, 5, 6
_CLASS[[*range(0, 10), *range(11, 32), 127]] = 7
for _i, _group in enumerate(_MARKS):
    _CLASS[[ord(c) for c in _group]] = 8 + _i
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Buckets into which the hashes of lower-cased words fall.
WORDS = 96
N_FEATURES = 256 + 3 + WORDS


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of some documents, and the number of the first passage of each.

    A document is cut every ``PASSAGE`` bytes; an empty one has one empty passage. Features: shares of pairs of neighbouring byte
    classes, share of words equal to the word before, mean word length, share of the passage that is filled, and shares of its words in ``WORDS`` hash buckets.
    """
    text, begins = separated(raw, offsets)
    lengths = np.diff(offsets)
    n = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(lengths)), lengths + 1)
    within = np.arange(len(text)) - begins[doc]
    owner = first[doc] + np.minimum(within // PASSAGE, n[doc] - 1)
    kind = _CLASS[text].astype(np.int64)
    total = int(first[-1])
    inside = doc[1:] == doc[:-1]  # no pair runs into the next document
    pairs = np.bincount((owner[:-1] * 256 + kind[:-1] * 16 + kind[1:])[inside], minlength=total * 256).reshape(total, 256).astype(np.float32)
    filled = np.maximum(1, np.bincount(owner, minlength=total)).astype(np.float32)
    out = np.zeros((total, N_FEATURES), np.float32)
    out[:, :256] = np.sqrt(pairs / filled[:, None])
    s, e = runs((text != 32) & (text != 10))
    if len(s):
        h = Rolling(text).of(s, e)
        same = np.zeros(len(s), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[s[1:]] == doc[s[:-1]])
        words = np.maximum(1, np.bincount(owner[s], minlength=total))
        out[:, 256] = np.bincount(owner[s], weights=same, minlength=total) / words
        out[:, 257] = np.minimum(4, np.bincount(owner[s], weights=e - s, minlength=total) / words / 8)
        bucket = (Rolling(_LOWER[text]).of(s, e) % np.uint64(WORDS)).astype(np.int64)
        out[:, 259:] = np.sqrt(np.bincount(owner[s] * WORDS + bucket, minlength=total * WORDS).reshape(total, WORDS) / words[:, None])
    out[:, 258] = np.minimum(1, filled / PASSAGE)
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """Encoder tanh(XW + b); attention softmax(w . tanh(HV) * sigmoid(HU)) over the passages of a document; logistic score of the weighted sum."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"W": draw(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p, at = self.p, first[:-1]
        h = np.tanh(((x - self.mean) * self.scale) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        n = np.diff(first)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, at), n))
        a = s / np.repeat(np.add.reduceat(s, at), n)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "n": n, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, first)
        dy = (f["y"] - y) / len(y)
        dz = np.repeat(dy[:, None] * p["c"], f["n"], axis=0)
        along = (dz * f["h"]).sum(axis=1)
        ds = f["a"] * (along - np.repeat(np.add.reduceat(f["a"] * along, first[:-1]), f["n"]))
        dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": ((x - self.mean) * self.scale).T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 4) -> GatedAttention:
        self.mean, self.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.02)
        rng, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                docs = order[i : i + batch]
                n = first[docs + 1] - first[docs]
                edge = np.concatenate([[0], np.cumsum(n)])
                rows = np.repeat(first[docs] - edge[:-1], n) + np.arange(edge[-1])
                step += 1
                for k, g in self.gradients(x[rows], edge, y[docs]).items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    move = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] = (self.p[k] - rate * (1 - epoch / epochs) * move).astype(np.float32)
        return self

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in blocks(offsets):
            at = offsets[a : b + 1]
            out.append(self.forward(*passages(raw[at[0] : at[-1]], at - at[0]))["y"])
        return np.concatenate(out)


_ROW = "y int, passages array<binary>"


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS) -> GatedAttention | None:
    """Learns from at most ``most`` labelled documents (all passages of each); None if they don't show both labels."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                at = offsets[a : b + 1]
                x, first = passages(raw[at[0] : at[-1]], at - at[0])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array([x[i:j].astype(np.float16).tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], names=["doc_id", "y", "x"])

    rows = labelled_texts(docs, labels, label, most).select(F.col("doc_id").cast("string"), "text", "y").mapInArrow(encode, "doc_id string, y int, x binary").orderBy("doc_id", "x").collect()
    y = np.array([r.y for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    parts = [np.frombuffer(r.x, np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in rows]
    return GatedAttention().fit(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), y)


def quality_scores(docs: DataFrame, labels: DataFrame, model: GatedAttention | None = None, label: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, score``.

    The model sees only texts; its labels come from rows that are not held out. Null and empty texts are one empty passage and
    get that passage's score; equal texts get equal scores. Without labels of both kinds every score is 0.5. Empty table: no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, label))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = shipped.value.score(*utf8(batch.column(1))) if shipped.value else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y.astype(np.float64))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(score, f"doc_id {id_type(docs)}, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns. Without labels of both kinds all rows stay."""
    shipped, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shipped.value.score(*utf8(batch.column(at))) >= threshold)) if shipped.value else batch

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
