"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibrated scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import Rolling, blocks, runs, separated, utf8
from ._labels import held_out, labelled_texts
from ._shared import discard, stored

#: Labelled examples at most, neighbours that vote, evidence kept.
EXAMPLES, NEIGHBOURS, EVIDENCE = 2500, 24, 3
#: Examples in a block of the index; documents that are scored together; a term in at least this share of the examples has a blocked list.
BLOCK, TOGETHER, FREQUENT = 32, 48, 1 / 8
#: Factor of a term that says nothing about the label.
PLAIN = 0.01
THRESHOLD = 0.3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(97, 123), *range(128, 256)]] = True


def document_terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``document, term`` of every word; terms are 64-bit hashes."""
    text, begins = separated(raw, offsets)
    text = _LOWER[text]
    s, e = runs(_WORD[text])
    return np.searchsorted(begins, s, side="right") - 1, Rolling(text).of(s, e)


def label_factors(n_with: np.ndarray, positive_with: np.ndarray, n: int, positive: int) -> np.ndarray:
    """By how much each term's weight is multiplied: ``PLAIN`` for all, and more for terms that depend on the label.

    That is the phi coefficient of term and label, after their chi-square has been lowered by what the largest of so many independent
    terms would reach by chance (2 ln of their number). No term is left out, and without dependent terms all weigh alike.
    """
    a, b = positive_with.astype(float), (n_with - positive_with).astype(float)
    c, d = positive - a, (n - positive) - b
    below = (a + b) * (c + d) * positive * (n - positive)
    chi2 = np.where(below > 0, n * (a * d - b * c) ** 2 / np.maximum(below, 1e-300), 0.0)
    return PLAIN + np.sqrt(np.maximum(0.0, chi2 - 2 * np.log(max(2, len(a)))) / max(1, n))


class Vectors:
    """TF-IDF vectors over all words of the examples: (1 + ln tf) * idf * label factor, unit length. A document without such words has none."""

    def __init__(self, terms: np.ndarray, scale: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.scale = terms[order], scale[order]

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``document, column, count`` in that order."""
        doc, term = document_terms(raw, offsets)
        if not len(self.terms) or not len(term):
            return (np.zeros(0, np.int64),) * 3
        column = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[column] == term
        cell, n = np.unique(doc[known] * len(self.terms) + column[known], return_counts=True)
        return cell // len(self.terms), cell % len(self.terms), n

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``columns, weights`` of each document."""
        return self.weighed(*self.counts(raw, offsets), len(offsets) - 1)

    def weighed(self, doc: np.ndarray, column: np.ndarray, n: np.ndarray, docs: int) -> list[tuple[np.ndarray, np.ndarray]]:
        weight = (1 + np.log(n)) * self.scale[column] if len(n) else np.zeros(0)
        norm = np.sqrt(np.bincount(doc, weights=weight**2, minlength=docs))
        weight = weight / norm[doc] if len(doc) else weight
        edge = np.searchsorted(doc, np.arange(docs + 1))
        return [(column[i:j], weight[i:j]) for i, j in zip(edge[:-1], edge[1:])]


Vector = tuple[np.ndarray, np.ndarray]


class BlockMaxIndex:
    """Inverted lists of unit vectors with block maxima: exact nearest vectors without scoring every block.

    Vectors are ordered so that like ones share a block of ``BLOCK``: by their heaviest frequent terms. Lists of frequent terms are stored block by
    block with the largest weight in each; lists of other terms are short and read in full. The bound of a block is the query's
    weights times its maxima, plus the largest sum that the short lists give to a vector in it. A query first scores its two best blocks,
    then every block whose bound reaches the k-th best similarity found. ``visited`` of ``searched`` blocks have been scored.
    """

    def __init__(self, vectors: list[Vector], n_terms: int, frequent: float = FREQUENT):
        self.n, self.visited, self.searched = len(vectors), 0, 0
        self.n_blocks = max(1, -(-self.n // BLOCK))
        self.size = self.n_blocks * BLOCK
        term = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in vectors)]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        owner = np.repeat(np.arange(self.n), [len(c) for c, _ in vectors]) if self.n else np.zeros(0, np.int64)
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) >= max(2, frequent * self.n))
        self.slot = np.full(n_terms, -1, np.int32)
        self.slot[often] = np.arange(len(often))
        full = np.zeros((self.n, len(often)))
        dense = self.slot[term] >= 0
        full[owner[dense], self.slot[term[dense]]] = weight[dense]
        heavy = np.argsort(-full, axis=1, kind="stable")[:, :3]
        self.order = np.lexsort((np.arange(self.n), *heavy.T[::-1]))
        self.lists = np.zeros((len(often), self.size))
        self.lists[:, : self.n] = full[self.order].T
        self.top = self.lists.reshape(len(often), self.n_blocks, BLOCK).max(axis=2)
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        by_term = np.argsort(term[~dense], kind="stable")
        self.rare_at, self.rare_weight = place[owner[~dense]][by_term], weight[~dense][by_term]
        self.rare_edge = np.searchsorted(term[~dense][by_term], np.arange(n_terms + 1))

    def similarities(self, queries: list[Vector], k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the similarities of all vectors by number (0: not scored or nothing in common), and its k-th best, 0 if there are fewer."""
        q, k = len(queries), min(k, self.size)
        column = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in queries)]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *(w for _, w in queries)])
        doc = np.repeat(np.arange(q), [len(c) for c, _ in queries])
        dense = self.slot[column] >= 0
        asked = np.zeros((q, len(self.lists)))
        asked[doc[dense], self.slot[column[dense]]] = weight[dense]
        column, weight, doc = column[~dense], weight[~dense], doc[~dense]
        n = self.rare_edge[column + 1] - self.rare_edge[column]
        at = np.repeat(self.rare_edge[column] - np.cumsum(n) + n, n) + np.arange(n.sum())
        rare = np.bincount(np.repeat(doc, n) * self.size + self.rare_at[at], weights=np.repeat(weight, n) * self.rare_weight[at], minlength=q * self.size).reshape(q, self.size)
        bound = asked @ self.top + rare.reshape(q, self.n_blocks, BLOCK).max(axis=2)
        out = np.zeros((q, self.size))

        def score(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows, part = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                out[rows, part] = np.round(rare[rows, part] + asked[rows] @ self.lists[:, part], 9)
            self.visited += int(wanted.sum())

        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :2], True, axis=1)
        score(first)
        kth = np.partition(out, self.size - k, axis=1)[:, self.size - k]
        score(~first & (bound > 1e-9) & (bound >= kth[:, None] - 1e-8))
        self.searched += bound.size
        kth = np.partition(out, self.size - k, axis=1)[:, self.size - k]
        by_number = np.zeros((q, self.n))
        by_number[:, self.order] = out[:, : self.n]
        return by_number, kth

    def nearest(self, columns: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and similarities of the ``k`` nearest vectors with similarity above 0."""
        sims = self.similarities([(columns, weights)], k)[0][0]
        best = np.lexsort((np.arange(self.n), -sims))[:k]
        best = best[sims[best] > 0]
        return best, sims[best]


class Neighbours:
    """Labelled examples with equal vectors stand as one with counts; the nearest vote by 1 / (1 - similarity + 0.05); leave-one-out votes calibrate."""

    def __init__(self, vectors: Vectors, examples: list[tuple[str, int, np.ndarray, np.ndarray]]):
        self.vectors = vectors
        groups: dict[tuple, list] = {}
        for doc_id, y, columns, weights in examples:
            groups.setdefault((columns.tobytes(), np.round(weights, 9).tobytes()), []).append((doc_id, y, columns, weights))
        bare = groups.pop((b"", b""), [])
        kept = list(groups.values())
        self.count = np.array([len(g) for g in kept], float)
        self.positive = np.array([sum(x[1] for x in g) for g in kept], float)
        self.proof = [sorted((x[0], x[1]) for x in g)[:EVIDENCE] for g in kept]
        n, p = len(examples), sum(x[1] for x in examples)
        self.base = (p + 0.5) / (n + 1)
        self.bare = (sum(x[1] for x in bare) + 2 * self.base) / (len(bare) + 2)
        self.index = BlockMaxIndex([(g[0][2], g[0][3]) for g in kept], len(vectors.terms))
        self.edges, self.values = np.zeros(0), np.zeros(0)
        votes = []
        for i in range(0, len(kept), TOGETHER):
            part = kept[i : i + TOGETHER]
            sims, kth = self.index.similarities([(g[0][2], g[0][3]) for g in part], NEIGHBOURS + 1)
            for y in (0, 1):  # every example is judged by the others: its own copy is taken out of its group
                has = np.array([sum(x[1] == y for x in g) for g in part])
                rows, own = np.arange(len(part)), np.arange(i, i + len(part))
                count, positive = np.tile(self.count, (len(part), 1)), np.tile(self.positive, (len(part), 1))
                count[rows, own] -= 1
                positive[rows, own] -= y
                out = self._votes(sims, kth, count, positive)
                votes += [(float(v), y) for v, h in zip(out, has) for _ in range(h)]
        self.edges, self.values = _rising(votes)

    def _votes(self, sims: np.ndarray, kth: np.ndarray, count: np.ndarray, positive: np.ndarray) -> np.ndarray:
        """Of all examples at least as near as the k-th, so that ties vote together. A group of equal examples counts 20 at most: it outvotes no other evidence."""
        w = np.where((sims > 0) & (sims >= kth[:, None]), 1 / (1.05 - np.minimum(1, sims)), 0.0)
        w = w * np.where(count > 0, np.minimum(count, 20) / np.maximum(count, 1), 0)
        return ((w * positive).sum(axis=1) + self.base) / ((w * count).sum(axis=1) + 1)

    def scores(self, documents: list[Vector]) -> list[tuple[float, list[tuple[str, float, int]]]]:
        """Score and evidence of each document."""
        out = []
        for i in range(0, len(documents), TOGETHER):
            part = documents[i : i + TOGETHER]
            sims, kth = self.index.similarities(part, NEIGHBOURS)
            votes = self._votes(sims, kth, self.count[None, :], self.positive[None, :])
            if len(self.edges) > 1:
                votes = np.interp(votes, self.edges, self.values)
            for (columns, _), vote, s, least in zip(part, votes.tolist(), sims, kth.tolist()):
                if not len(columns):
                    out.append((self.bare, []))
                    continue
                near = np.flatnonzero((s > 0) & (s >= least))
                near = near[np.lexsort((near, -s[near]))[:EVIDENCE]].tolist()
                out.append((vote, [(d, round(float(s[g]), 6), y) for g in near for d, y in self.proof[g]][:EVIDENCE]))
        return out


def _rising(votes: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours that fall: mean vote and share of positives of each pool."""
    pools: list[list[float]] = []
    for v, y in sorted(votes):
        pools.append([v, y, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            v1, y1, n1 = pools.pop()
            v0, y0, n0 = pools.pop()
            pools.append([(v0 * n0 + v1 * n1) / (n0 + n1), y0 + y1, n0 + n1])
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.2) / (p[2] + 1) for p in pools])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = EXAMPLES) -> Neighbours | None:
    """Index of at most ``most`` labelled examples with all their words. Document frequencies of these words are counted over all of ``docs``."""
    sample = stored(labelled_texts(docs, labels, label, most), "examples")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                at = offsets[a : b + 1]
                doc, term = document_terms(raw[at[0] : at[-1]], at - at[0])
                order = np.lexsort((term, doc))
                doc, term = doc[order], term[order]
                new = np.ones(len(term), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
                n = np.diff(np.append(np.flatnonzero(new), len(term))).astype(np.int32)
                doc, term = doc[new], term[new]
                edge = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
                packed = [[x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])] for x in (term, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], *(pa.array(x, pa.binary()) for x in packed)], names=["doc_id", "y", "t", "n"])

    rows = sample.select(F.col("doc_id").cast("string"), "text", "y").mapInArrow(encode, "doc_id string, y int, t binary, n binary").orderBy("doc_id").collect()  # at most SAMPLE_BYTES of text
    discard(sample)
    y = np.array([r.y for r in rows], np.int64)
    if not y.sum() or y.all():
        return None
    term = [np.frombuffer(r.t, np.uint64) for r in rows]
    count = np.concatenate([np.frombuffer(r.n, np.int32) for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(t) for t in term])
    terms, column = np.unique(np.concatenate(term), return_inverse=True)
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(Vectors(terms, np.ones(len(terms))))  # 16 bytes for each word of the examples

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(shipped.value.terms), np.int64), 0
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            rows += batch.num_rows
            for a, b in blocks(offsets):
                at = offsets[a : b + 1]
                df += np.bincount(shipped.value.counts(raw[at[0] : at[-1]], at - at[0])[1], minlength=len(df))
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, found)), pa.array(np.append(rows, df[found]))], names=["i", "df"])

    total = docs.select(F.col("text").cast("string")).mapInArrow(frequencies, "i long, df long").groupBy("i").agg(F.sum("df").alias("df")).toPandas()
    df, seen = np.zeros(len(terms)), int(total.df[total.i == -1].sum())
    known = total[total.i >= 0]
    df[known.i.to_numpy()] = known.df.to_numpy()
    factor = label_factors(np.bincount(column, minlength=len(terms)), np.bincount(column, weights=y[doc], minlength=len(terms)), len(y), int(y.sum()))
    vectors = Vectors(terms, (np.log((1 + seen) / (1 + df)) + 1) * factor)
    order = np.lexsort((column, doc))
    weighed = vectors.weighed(doc[order], column[order], count[order], len(rows))
    return Neighbours(vectors, [(r.doc_id, r.y, c, w) for r, (c, w) in zip(rows, weighed)])


def toxicity_scores(docs: DataFrame, labels: DataFrame, model: Neighbours | None = None, label: str = "toxic") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, score, evidence`` (nearest labelled examples: id, similarity, label).

    A text without any word of the examples, null and empty ones too, gets the smoothed share of toxic examples among such examples.
    Equal texts get equal scores; ties between neighbours go to equal examples together, then to the smaller number.
    Without labels of both kinds every score is 0. Empty table: no rows. Only the index (bounded by ``EXAMPLES`` and ``SAMPLE_BYTES``) is broadcast.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, label))
    proof = pa.list_(pa.struct([("doc_id", pa.string()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            rows = []
            for a, b in blocks(offsets):
                at = offsets[a : b + 1]
                rows += model.scores(model.vectors.of(raw[at[0] : at[-1]], at - at[0])) if model else [(0.0, [])] * (b - a)
            found = [[{"doc_id": d, "similarity": s, "label": y} for d, s, y in p] for _, p in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in rows], pa.float64()), pa.array(found, proof)], names=["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(score, f"doc_id {kind}, score double, evidence array<struct<doc_id:string,similarity:double,label:int>>")
    return scored.select("doc_id", "score", F.col("evidence").cast(f"array<struct<doc_id:{kind},similarity:double,label:int>>").alias("evidence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
