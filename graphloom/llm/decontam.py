"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over every document and verified."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import Rolling, blocks, runs, separated, utf8
from ._shared import id_type, stored

WINDOW = 10
#: Bytes of benchmark text whose windows are broadcast at once. A larger benchmark is scanned in so many blocks, each over all documents.
BLOCK = 8 << 20

# Bytes that are parts of words after A-Z are lower-cased (digits, a-z, all of multi-byte characters).
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _words(raw: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, word starts and ends, and for each document the number of its first word."""
    text, begins = separated(raw, offsets)
    text = _LOWER[text]
    starts, ends = runs(_WORD[text])
    return text, starts, ends, np.searchsorted(starts, np.append(begins, len(text)))


class WindowSet:
    """Windows of some benchmark items: their hashes by length, and the words themselves to verify a hit."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.known: dict[int, dict[int, dict[bytes, set[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for item, words in items:
            raw = np.frombuffer((words or "").encode(), np.uint8)
            if not len(raw):
                continue
            text, s, e, _ = _words(raw, np.array([0, len(raw)]))
            if not len(s):
                continue
            n = min(window, len(s))
            hashes = Rolling(Rolling(text).of(s, e)).windows(n)
            data = text.tobytes()
            for i, h in enumerate(hashes.tolist()):
                self.known[n][h][b" ".join(data[a:b] for a, b in zip(s[i : i + n].tolist(), e[i : i + n].tolist()))].add(item)
        self.known = {n: {h: {k: sorted(v) for k, v in d.items()} for h, d in by.items()} for n, by in self.known.items()}

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, list[str]]], np.ndarray, np.ndarray]]:
        """For each document: number, words, verified hits (first word, length, items), and word spans in bytes of the document."""
        for a, b in blocks(offsets):
            at = offsets[a : b + 1]
            text, s, e, first = _words(raw[at[0] : at[-1]], at - at[0])
            begins = (at[:-1] - at[0]) + np.arange(b - a)
            hits: dict[int, list] = defaultdict(list)
            if len(s):
                rolled = Rolling(Rolling(text).of(s, e))
                data = text.tobytes()
                for n, known in self.known.items():
                    if n > len(s):
                        continue
                    keys = np.sort(np.fromiter(known, np.uint64, len(known)))
                    h = rolled.windows(n)
                    near = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    for i in np.flatnonzero(keys[near] == h).tolist():
                        d = int(np.searchsorted(first, i, side="right")) - 1
                        if i + n > first[d + 1]:
                            continue  # it runs into the next document
                        found = known[int(h[i])].get(b" ".join(data[x:y] for x, y in zip(s[i : i + n].tolist(), e[i : i + n].tolist())))
                        if found:
                            hits[d].append((i - int(first[d]), n, found))
            for d in range(b - a):
                x, y = first[d], first[d + 1]
                yield a + d, int(y - x), hits.get(d, []), s[x:y] - begins[d], e[x:y] - begins[d]


_OUT = "_key long, _id {id}, n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, item_ids array<string>"


def _scanned(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """Of rows ``_key, _id, text``; ``spans`` are merged runs of hit words: first and last word (exclusive), and byte range in the text."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(WindowSet(items, window))
    span = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = [], [], []
            for _, n, hits, s, e in shipped.value.scan(*utf8(batch.column(2))):
                mask = np.zeros(n, bool)
                for i, size, _ in hits:
                    mask[i : i + size] = True
                x, y = runs(mask) if hits else ((), ())
                n_words.append(n)
                spans.append([{"first": int(i), "last": int(j), "start": int(s[i]), "end": int(e[j - 1])} for i, j in zip(x, y)])
                items.append(sorted({k for h in hits for k in h[2]}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=["_key", "_id", "n_words", "spans", "item_ids"])

    return docs.select("_key", "_id", "text").mapInArrow(scan, _OUT.format(id=id_type(docs, "_id")))


def _item_blocks(benchmark: DataFrame) -> list[list[tuple[str, str]]]:
    """The items in blocks of at most ``BLOCK`` bytes (one item at least), read block by block from range-cut parts."""
    sized = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, -(-2 * total // BLOCK)) if total > BLOCK else 1
    if parts == 1:
        yield [(r.item_id, r.text) for r in sized.collect()]  # BLOCK bytes at most
        return
    for p in range(parts):
        yield [(r.item_id, r.text) for r in sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, spans, item_ids``.

    Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. Each ``window`` consecutive words of
    an item, or all of a shorter item, are hashed into a broadcast set; every word position of every document is
    looked up, and a hit counts only when the words themselves are equal. A benchmark of over ``BLOCK`` bytes is taken in
    blocks: all documents are scanned for each, and the hits of all blocks are merged row by row, so what is broadcast stays bounded.

    Null or empty text: no words, no spans. Items without words: never found. Null item ids: their windows count as hits of an
    item without a name. Repeated rows: a row each. Other columns play no part.
    """
    chosen = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    items = _item_blocks(benchmark)
    first, second = next(items), next(items, None)
    if second is None:
        found = _scanned(chosen.withColumn("_key", F.lit(0).cast("long")), _named(first), window)
    else:
        found = _merged(_numbered(chosen), chain([first, second], items), window)
    return found.select(F.col("_id").alias("doc_id"), "n_words", "spans", "item_ids")


def _named(items: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(i if i is not None else "", t) for i, t in items]


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows, each with a ``_key`` of its own: written once, as every block must see the same."""
    return stored(rows.withColumn("_key", F.monotonically_increasing_id()), "decontam")


def _merged(keyed: DataFrame, items: Iterable[list[tuple[str, str]]], window: int) -> DataFrame:
    """Hits of all blocks for each ``_key``: all rows of the first block's scan, and of the others those with hits."""
    both = None
    for block in items:
        part = _scanned(keyed, _named(block), window)
        both = part if both is None else both.unionByName(part.filter(F.size("spans") > 0))
    flat = both.groupBy("_key").agg(F.max("_id").alias("_id"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    spans = F.expr("""
      aggregate(array_sort(spans), cast(array() as array<struct<first:long,last:long,start:long,end:long>>), (acc, x) ->
        case when size(acc) > 0 and element_at(acc, -1).last >= x.first
          then concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, x.last), 'start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
          else concat(acc, array(x)) end)""")
    return flat.withColumn("spans", spans)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns (whole documents are removed)."""
    spark, columns, kept = docs.sparkSession, docs.columns, docs
    for items in _item_blocks(benchmark):
        shipped = spark.sparkContext.broadcast(WindowSet([(i or "", t) for i, t in items], window))
        at = columns.index("text")

        def clean(batches, shipped=shipped):
            for batch in batches:
                hit = np.array([not hits for _, _, hits, _, _ in shipped.value.scan(*utf8(batch.column(at)))], bool)
                yield batch.filter(pa.array(hit, pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text`` with the byte ranges of hit word runs of all items cut out at once (span mode). Null text stays null."""
    keyed = _numbered(docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")))
    found = _merged(keyed, _item_blocks(benchmark), window).filter(F.size("spans") > 0).select("_key", "spans")

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if spans:
                    raw, at, kept = text.encode(), 0, []
                    for span in spans:
                        kept.append(raw[at : span["start"]])
                        at = span["end"]
                    text = b"".join([*kept, raw[at:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return keyed.join(found, "_key", "left").select("_id", "text", "spans").mapInArrow(cut, f"doc_id {id_type(keyed, '_id')}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
dg AS (SELECT doc_id, i, k.n, array_to_string(w[i:i + k.n - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw) x, (SELECT DISTINCT n FROM bg) k WHERE i + k.n - 1 <= len(w)),
h AS (SELECT dg.doc_id, dg.i, dg.n, bg.item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS ids FROM h GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
