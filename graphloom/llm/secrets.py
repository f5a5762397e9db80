"""Secret scans: base patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import id_type

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
KINDS = ("assign", "access", "hex", "random")

# Ordinary words of identifiers, learned from beside the corpus's own.
COMMON = """value index count name total buffer result user item error message handler request response connection configuration internal
international organization initialize everything something default parameter function variable condition iterator container directory
filename extension version language translation description environment application service process thread queue window
button color image position length width height number string object array vector matrix table column update delete insert
select create remove check test example sample document database network address account customer product
platform support engine session cookie header timeout retry layout screen module import export render schedule worker cluster storage
memory cache parser token stream reader writer client server socket channel event listener callback promise future state store action
reducer component property style theme font margin border padding align center bottom title label field form input output submit
validate format convert encode decode encrypt compress archive backup restore migrate schema query filter order group limit offset page
report summary detail history audit logger trace debug info warning fatal metric counter gauge timer clock calendar date month year""".split()

#: Shortest string that the models judge; rows and words of the corpus, and made-up strings, that they learn from.
LEAST, TRAIN_ROWS, TRAIN_WORDS, TRAIN_STRINGS = 20, 400, 5000, 4000
#: Different characters that a random string has at least: rulers and padding have fewer.
DIFFERENT = 7
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
# Characters of a run that part words in paths and assignments.
MARKS = "/.=-_"
_MARK = re.compile(r"[/.=_-]")
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def apart(spans: list[tuple[int, int, str]], others: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The ``spans`` that share no place with any of ``others``: of those that start before a span's end, none ends after its start."""
    others = sorted(others)
    starts = [o[0] for o in others]
    far = [0, *accumulate((o[1] for o in others), max)]
    return [s for s in spans if far[bisect_left(starts, s[1])] <= s[0]]


class RandomStrings:
    """First-order character models of the two classes; the log-likelihood ratio per step decides, above a threshold that ordinary strings of other words (``unseen``) set."""

    def __init__(self, ordinary: list[str], random_strings: list[str], unseen: list[str], allowed: float = 0.002):
        n = len(ALPHABET)
        tables = []
        for sample in (random_strings, ordinary):
            counts = np.full((n, n), 0.5)
            for s in sample:
                c = _CODE[np.frombuffer(s.encode(), np.uint8)]
                np.add.at(counts, (c[:-1], c[1:]), 1)
            tables.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
        self.ratio = tables[0] - tables[1]
        scores = np.sort([self.score(s) for s in unseen if len(s) >= LEAST] or [0.0])
        self.threshold = max(0.0, float(scores[min(len(scores) - 1, int(len(scores) * (1 - allowed)))])) + 0.1
        # A long run holds many windows: the bar is the highest window of nearly all such strings, joined in fours.
        joined = ["/".join(unseen[i : i + 4]) for i in range(0, len(unseen), 4)]
        tops = sorted(float(w.max()) for w in map(self.windows, joined) if len(w)) or [0.0]
        self.bar = max(0.0, tops[int((len(tops) - 1) * (1 - 5 * allowed))]) + 0.1

    def score(self, s: str) -> float:
        c = _CODE[np.frombuffer(s.encode(), np.uint8)]
        return float(self.ratio[c[:-1], c[1:]].mean())

    def windows(self, s: str) -> np.ndarray:
        """Mean ratio of each ``LEAST`` consecutive characters."""
        c = _CODE[np.frombuffer(s.encode(), np.uint8)]
        total = np.append(0, np.cumsum(self.ratio[c[:-1], c[1:]]))
        return (total[LEAST - 1 :] - total[: 1 - LEAST]) / (LEAST - 1)

    def within(self, s: str) -> list[tuple[int, int]]:
        """The whole of ``s`` if it looks random, or else its parts that do: windows above the bar, as far as the marks around them."""
        if self.score(s) > self.threshold:
            return [(0, len(s))]
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(self.windows(s) > self.bar).tolist():
            if found and i <= found[-1][1]:
                found[-1] = (found[-1][0], max(found[-1][1], i + LEAST))
            else:
                found.append((i, i + LEAST))
        if not found:
            return found
        marks = [-1, *(m.start() for m in _MARK.finditer(s)), len(s)]
        out: list[tuple[int, int]] = []
        for a, b in found:
            a, b = marks[bisect_left(marks, a + 1) - 1] + 1 if s[a] not in MARKS else a + 1, marks[bisect_left(marks, b)]
            if out and a <= out[-1][1]:
                a = out.pop()[0]
            out.append((a, b))
        return out

    def spans(self, text: str, others: list[tuple[int, int, str]] = ()) -> list[tuple[int, int, str]]:
        """Random strings in the runs of secret-like characters, without the places of ``others``."""
        taken = sorted((o[0], o[1]) for o in others)
        starts, far = [o[0] for o in taken], [0, *accumulate((o[1] for o in taken), max)]
        out = []
        for m in _CANDIDATE.finditer(text):
            at, i = max(m.start(), far[bisect_left(starts, m.start())]), bisect_left(starts, m.start())
            free = []
            while i < len(taken) and taken[i][0] < m.end():
                free.append((at, taken[i][0]))
                at, i = max(at, taken[i][1]), i + 1
            for a, b in [*free, (at, m.end())]:
                if b - a >= LEAST:
                    out += [(a + x, a + y, "random") for x, y in self.within(text[a:b]) if len(set(text[a + x : a + y])) >= DIFFERENT]
        return out


def identifiers(words: list[str], n: int, rng: random.Random) -> list[str]:
    """Ordinary strings: words joined in the usual ways, some in capitals, some with numbers."""
    out = []
    for i in range(n):
        parts = []
        while sum(map(len, parts)) < LEAST:
            parts.append(rng.choice(words))
        if i % 5 in (2, 4):
            parts = [p.capitalize() for p in parts]
        if i % 3 == 0:
            parts.append(str(rng.randrange(1000)))
        name = ("_", ".", "", "-", "/")[i % 5].join(parts)
        out.append(name.upper() if i % 10 in (0, 3) else name)
    return out


def labelled_samples(words: list[str], n: int = TRAIN_STRINGS, seed: int = 9) -> tuple[list[str], list[str], list[str]]:
    """Ordinary identifiers put together from two thirds of ``words``, random strings over the usual alphabets, and identifiers of the other words; the same for the same words."""
    rng = random.Random(seed)
    words = sorted({*COMMON, *words})
    rng.shuffle(words)
    known, others = words[: 2 * len(words) // 3], words[2 * len(words) // 3 :]
    letters = ALPHABET[:62]
    kinds = ("0123456789abcdef", "0123456789ABCDEF", letters[:26] + "234567", letters[26:62], letters, letters + "+/", letters + "_-")
    made = ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randrange(LEAST, 65))) for i in range(n)]
    return identifiers(known, n, rng), made, identifiers(others, n // 2, rng)


def fit(docs: DataFrame, text_col: str = "text") -> RandomStrings:
    """Learns from a bounded sample: plain words of the ``TRAIN_ROWS`` rows with the least text hashes, ``TRAIN_WORDS`` words at most."""
    hashed = docs.select(F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_t"))
    edge = hashed.select("_h").orderBy("_h").limit(TRAIN_ROWS).agg(F.max("_h")).first()[0]
    words: list[str] = []
    if edge is not None:
        sample = hashed.filter(F.col("_h") <= edge).dropDuplicates(["_h"])
        word = sample.select(F.explode(F.regexp_extract_all("_t", F.lit(r"\b[A-Za-z][a-z]{1,14}\b"), F.lit(0))).alias("w")).distinct()
        words = [r.w for r in word.orderBy(F.xxhash64("w"), "w").limit(TRAIN_WORDS).collect()]
    return RandomStrings(*labelled_samples(words))


def secret_scan(docs: DataFrame, model: RandomStrings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, spans`` with kind, start and end in code points, by start, then kind as listed.

    Kinds ``assign``, ``access`` and ``hex`` are the base patterns; ``random`` are further strings of secret-like characters whose
    log-likelihood ratio (random model over ordinary model, per step) exceeds the threshold, as whole runs or in windows of ``LEAST``
    characters within longer runs (grown to the marks around them). What base spans cover is cut out of the runs first.
    Null or empty text: no spans. Equal rows: equal spans. Empty table: no rows, and the models learn from made-up words.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text_col))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = base_spans(text)
                extra = shipped.value.spans(text, found)
                found = sorted(found + extra, key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], names=["doc_id", "spans"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(scan, f"doc_id {id_type(chosen)}, spans array<struct<kind:string,start:long,end:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("random"))
