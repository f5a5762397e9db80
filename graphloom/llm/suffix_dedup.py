"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else. Sorting the suffixes of all starts would move about
200 times the input, so starts are sorted in groups, and hashes only choose what is sorted; whether strings are equal is always
settled by their bytes, in the merge:

1. Every string of ``LENGTH`` bytes holds an anchor: the place of the least hash among its substrings of ``PIECE`` bytes. Equal strings
   have equal anchors at equal offsets, so starts whose anchor piece occurs once (by hash) are unique and leave here. (``_anchor_rows``)
2. The starts of one anchor make one context: all bytes from the first start to the end of the last one's string. Contexts whose hashes
   occur twice are sorted and merged as strings; equal ones repeat all their starts.
3. Contexts that are unequal to all others, and one of each equal class with the same piece as a partner, are cut into blocks of ``STEP`` starts,
   counted from the anchor, which go through the same sort.
4. The starts of blocks that are still unequal, and their partners', become suffixes of ``LENGTH`` bytes; those whose hashes occur twice are sorted.

Each sort has one form (``_merge_sort``). Tasks sort runs and settle what is equal inside a run; runs are cut at range splitters and exchanged
front-coded (``front_code``): each string as the length of the prefix that it shares with the one before, and its other bytes. A range
merges its runs in a loser tree that keeps, for each run's head, the prefix length known to be shared with the string put out
last (``merge_runs``), so no known prefix is compared again. Texts that occur twice are repeats as a whole, told by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import Rolling, blocks, lists, mixed, runs, utf8
from ._shared import discard, parallelism, stored
from .prefix import prefix_sums

LENGTH, PIECE, STEP = 200, 80, 16
#: Bytes of a sorted run, strings in a range of the merge, about; strings for one that the splitters are chosen from, and bytes kept of it.
RUN_BYTES, RANGE, EVERY, PREFIX = 16 << 20, 1 << 17, 64, 64
#: Texts that go to Python at once.
TEXTS = 512
#: A key with more than one row in ``HOT`` is dealt over ``SALT`` parts; there are fewer than ``HOT`` such keys whatever the input.
HOT, SALT = 4096, 64

# An anchor is one number: its place in the text, how far before it its first start lies, and how many starts follow that one.
_PACK = 256


def _anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``row, piece, context, place, first start, last start`` of every anchor; the last three count from the start of the row's text."""
    n, width = len(raw), LENGTH - PIECE + 1
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 6
    rolled = Rolling(raw)
    h = rolled.windows(PIECE)
    bits = np.uint64(max(20, n.bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    ends = np.repeat(offsets[1:], np.diff(offsets))[: n - LENGTH + 1]
    start = np.flatnonzero(np.arange(n - LENGTH + 1) + LENGTH <= ends)
    if not len(start):
        return (np.zeros(0, np.int64),) * 6
    anchor = (low[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = start[np.append(first[1:], len(start)) - 1]
    place, first = anchor[first], start[first]
    context = mixed(rolled.of(first, last + LENGTH) + (place - first).astype(np.uint64))
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, h[place], context, place - offsets[row], first - offsets[row], last - offsets[row]


def _masked(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1)).view(np.int64)


def _anchor_rows(texts: DataFrame, bits: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            h, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in blocks(offsets):
                at = offsets[a : b + 1]
                row, piece, context, place, first, last = _anchors(raw[at[0] : at[-1]], at - at[0])
                packed = (place * _PACK + (place - first)) * _PACK + (last - first)
                columns = [_masked(piece, bits), _masked(context, bits), h[a:b][row], h2[a:b][row], packed] if len(row) else [np.zeros(0, np.int64)] * 5
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["piece", "context", "h", "h2", "at"])

    return texts.select("h", "h2", "text").mapInArrow(find, "piece long, context long, h long, h2 long, at long")


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = at // (_PACK * _PACK)
    first = place - at // _PACK % _PACK
    return place, first, first + at % _PACK


def _block_rows(segments: DataFrame, bits: int) -> DataFrame:
    """The starts of each segment in blocks of ``STEP``, counted from the anchor, so that equal starts fall into equal blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = utf8(batch.column(4))
            place, first, last = _unpacked(batch.column(2).to_numpy())
            lo, hi = (first - place) // STEP, (last - place) // STEP
            n = hi - lo + 1
            seg = np.repeat(np.arange(len(n)), n)
            block = lo[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
            zero = offsets[seg] + (place - first)[seg]  # the anchor in the joined bytes
            begin = np.maximum(block * STEP, (first - place)[seg])
            end = np.minimum(block * STEP + STEP - 1, (last - place)[seg])
            rolled = Rolling(raw)
            mark = mixed((block + 1024).astype(np.uint64))
            piece = mixed(rolled.of(zero + block * STEP + STEP - 1, zero + block * STEP + LENGTH) ^ mark)
            context = mixed(rolled.of(zero + begin, zero + end + LENGTH) ^ mark + begin.astype(np.uint64))
            where = ((place[seg] + begin) * _PACK) * _PACK + (end - begin)
            h, h2, at = (batch.column(c).to_numpy()[seg] for c in range(3))
            settled = batch.column(3).to_numpy(zero_copy_only=False)[seg]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (_masked(piece, bits), _masked(context, bits), h, h2, where, at, settled))], names=["piece", "context", "h", "h2", "at", "seg", "settled"])

    return segments.select("h", "h2", "at", "settled", "bytes").mapInArrow(cut, "piece long, context long, h long, h2 long, at long, seg long, settled boolean")


def _spread(rows: DataFrame, keys: DataFrame, on: list[str], by: list[str], how: str = "left_semi") -> DataFrame:
    """``rows`` joined with ``keys`` (``on`` and n, the rows of each). A hot key is repeated for each of ``SALT`` parts over which its rows go by the hash of ``by``."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    key = F.xxhash64(*on)
    hot = [r.key for r in keys.filter((F.col("n") * HOT > total) & (F.col("n") > 1000)).select(key.alias("key")).distinct().collect()]  # fewer than HOT
    if not hot:
        return rows.join(keys, on, how)
    is_hot = key.isin(hot)  # on both sides, so keys that share a hash are dealt alike
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int")).otherwise(F.lit(0)))
    parts = keys.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(parts, [*on, "_salt"], how).drop("_salt")


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted strings: lengths of the prefixes shared with the string before, lengths, and all other bytes."""
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    shared, tails = np.zeros(len(strings), np.int64), []
    for i in range(0, len(strings), 4096):
        lead = strings[i - 1 : i] if i else [b""]
        part = lead + strings[i : i + 4096]
        width = max(map(len, part), default=0)
        flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), np.uint8).reshape(len(part), width)
        differ = flat[1:] != flat[:-1]
        size = length[i : i + 4096]
        before = np.append(len(lead[0]), size[:-1])
        here = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(size, before))
        shared[i : i + 4096] = here
        place = np.arange(width)[None, :]
        tails.append(flat[1:][(place >= here[:, None]) & (place < size[:, None])].tobytes())
    return shared.astype(np.uint16), length.astype(np.uint16), b"".join(tails)


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    return n if x == y else n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def merge_runs(coded: list[tuple[list[int], list[int], bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Merges front-coded runs (prefix lengths, lengths, other bytes): ``run, number in the run, prefix shared with the string put out before, string``, in order.

    The tree holds losers. Each knows how much it shares with the string that beat it, which is the one last put out along its
    path; of two that share unlike lengths with that one, the longer wins unseen; only at equal lengths are bytes compared, from there on.
    """
    k = len(coded)
    size = 1 << max(0, (k - 1).bit_length())
    at, eaten, head = [0] * k, [0] * k, [b""] * k

    def pull(r: int) -> int:
        """The next string of run r becomes its head; how much it shares with the head before, or -1 at the end."""
        shared, length, tails = coded[r]
        i = at[r]
        if i == len(shared):
            return -1
        at[r] = i + 1
        s, e = shared[i], eaten[r]
        eaten[r] = to = e + length[i] - s
        head[r] = head[r][:s] + tails[e:to]
        return s

    loser, known = [0] * size, [-1] * size

    def play(r: int, s: int, node: int) -> tuple[int, int]:
        """Run r (sharing s with the last winner, -1: at its end) meets the loser at ``node``; the winner and its length go on."""
        q, t = loser[node], known[node]
        if s > t:
            return r, s
        if s < t:
            loser[node], known[node] = r, s
            return q, t
        if s < 0:
            return r, s
        a, b = head[r], head[q]
        c = _common(a, b, s)
        if c == len(a) or c < len(b) and a[c] < b[c]:
            known[node] = c
            return r, s
        loser[node], known[node] = r, c
        return q, t

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            r = node - size
            return (r, pull(r)) if r < k else (0, -1)
        loser[node], known[node] = build(2 * node)
        return play(*build(2 * node + 1), node)

    r, s = build(1) if size > 1 else (0, pull(0) if k else -1)
    while s >= 0:
        yield r, at[r] - 1, s, head[r]
        node, s = (r + size) // 2, pull(r)
        while node:
            r, s = play(r, s, node)
            node //= 2


#: What a string stands for: a text, packed starts in it, the piece by which it was chosen, and whether its starts are settled already.
_WHO = ["h", "h2", "at", "piece", "settled"]
_CODED = "kind int, h array<long>, h2 array<long>, at array<long>, piece array<long>, settled array<boolean>, known array<boolean>, shared binary, length binary, tails binary, sample array<binary>"
_IDS = [("h", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())), ("piece", pa.list_(pa.int64())), ("settled", pa.list_(pa.bool_())), ("known", pa.list_(pa.bool_()))]
_CODED_SCHEMA = pa.schema([("kind", pa.int32()), *_IDS, ("shared", pa.binary()), ("length", pa.binary()), ("tails", pa.binary()), ("sample", pa.list_(pa.binary()))])
_OPEN, _RUN, _AGAIN = 0, 1, 2


def _coded_row(kind: int, who: list[tuple], known: list[bool], strings: list[bytes], coded: bool) -> pa.RecordBatch:
    ids = dict(zip(_WHO, map(list, zip(*who)))) if who else {c: [] for c in _WHO}
    row = {"kind": kind, **ids, "known": known, "shared": None, "length": None, "tails": None, "sample": []}
    if coded:
        shared, length, tails = front_code(strings)
        row |= {"shared": shared.tobytes(), "length": length.tobytes(), "tails": tails, "sample": [x[:PREFIX] for x in strings[EVERY // 2 :: EVERY]]}
    elif strings:
        row |= {"length": np.fromiter(map(len, strings), np.uint16, len(strings)).tobytes(), "tails": b"".join(strings)}
    return pa.RecordBatch.from_pylist([row], schema=_CODED_SCHEMA)


def _sorted_runs(rows: Iterator[tuple[bool, bytes, tuple]]) -> Iterator[pa.RecordBatch]:
    """From (to be sorted, string, who): sorted runs without repeats, what repeats inside a run, and strings that are not to be sorted as they are."""
    buffer: list[tuple[bytes, tuple]] = []
    bag: list[tuple[bytes, tuple]] = []
    size = bag_size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        buffer.sort()
        strings, who, known, again = [], [], [], []
        for string, one in buffer:
            if strings and string == strings[-1]:
                known[-1] = True
                again.append(one)
            else:
                strings.append(string)
                who.append(one)
                known.append(False)
        yield _coded_row(_RUN, who, known, strings, True)
        if again:
            yield _coded_row(_AGAIN, again, [], [], False)

    for to_sort, string, who in rows:
        if to_sort:
            buffer.append((string, who))
            size += len(string) + 100
            if size > RUN_BYTES:
                yield from emit()
                buffer, size = [], 0
        else:
            bag.append((string, who))
            bag_size += len(string)
            if bag_size > 1 << 20:
                yield _coded_row(_OPEN, [w for _, w in bag], [], [x for x, _ in bag], False)
                bag, bag_size = [], 0
    if buffer:
        yield from emit()
    if bag:
        yield _coded_row(_OPEN, [w for _, w in bag], [], [x for x, _ in bag], False)


_ROW = "h long, h2 long, at long, piece long, settled boolean, equal boolean, lead boolean, bytes binary"


def _cut_runs(coded: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Runs cut at the splitters: ``range`` and the columns of a run."""
    shipped = coded.sparkSession.sparkContext.broadcast(splitters)  # PREFIX bytes for each RANGE strings
    names = ["h", "h2", "at", "piece", "settled", "known"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shared, length, tails = np.frombuffer(row["shared"], np.uint16), np.frombuffer(row["length"], np.uint16), row["tails"]
                end = np.cumsum(length.astype(np.int64) - shared)
                begin, string, where, firsts = 0, b"", [], {}
                for i, (s, e) in enumerate(zip(shared.tolist(), end.tolist())):
                    string = string[:s] + tails[begin:e]
                    begin = e
                    r = bisect_right(shipped.value, string)
                    if not where or where[-1] != r:
                        firsts[i] = string
                    where.append(r)
                edge = [*firsts, len(where)]
                out = []
                for i, j in zip(edge[:-1], edge[1:]):
                    mine = shared[i:j].copy()
                    mine[0] = 0
                    out.append({"range": where[i], **{c: row[c][i:j] for c in names}, "shared": mine.tobytes(), "length": length[i:j].tobytes(), "tails": firsts[i] + tails[end[i] : end[j - 1]]})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("range", pa.int32()), *_IDS, ("shared", pa.binary()), ("length", pa.binary()), ("tails", pa.binary())]))

    return coded.select("shared", "length", "tails", *names).mapInArrow(cut, "range int, h array<long>, h2 array<long>, at array<long>, piece array<long>, settled array<boolean>, known array<boolean>, shared binary, length binary, tails binary")


def _merge_range(table: pa.Table) -> pa.Table:
    """Of the runs of one range, every string's ids, whether it has an equal, and, of one of each equal class (``lead``), its bytes."""
    rows = table.to_pylist()
    coded = [(np.frombuffer(x["shared"], np.uint16).tolist(), np.frombuffer(x["length"], np.uint16).tolist(), x["tails"]) for x in rows]
    run, place, equal, lead, data, before = [], [], [], [], [], None
    for r, i, s, string in merge_runs(coded):
        same = before is not None and s == len(string) == len(before)
        if same:
            equal[-1] = True
        run.append(r)
        place.append(i)
        equal.append(same or rows[r]["known"][i])
        lead.append(not same)
        data.append(None if same else string)
        before = string
    offset = np.concatenate([[0], np.cumsum([len(x["h"]) for x in rows])])[np.array(run, np.int64)] + np.array(place, np.int64)
    ids = [pa.array([v for x in rows for v in x[c]], pa.bool_() if c == "settled" else pa.int64()).take(pa.array(offset)) for c in _WHO]
    return pa.table([*ids, pa.array(equal, pa.bool_()), pa.array(lead, pa.bool_()), pa.array(data, pa.binary())], names=[*_WHO, "equal", "lead", "bytes"])


def _unbagged(coded: DataFrame) -> DataFrame:
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                length = np.frombuffer(row["length"], np.uint16)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                strings = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(row["tails"])])
                no = pa.array(np.zeros(len(length), bool))
                yield pa.RecordBatch.from_arrays([*(pa.array(row[c], pa.int64()) for c in _WHO[:4]), pa.array(row["settled"], pa.bool_()), no, pa.array(np.ones(len(length), bool)), strings], names=[*_WHO, "equal", "lead", "bytes"])

    return coded.select("length", "tails", *_WHO).mapInArrow(out, _ROW)


def _merge_sort(coded: DataFrame) -> DataFrame:
    """Merges the runs of a table of sorted runs: a row (``_ROW``) for each string, those that repeated inside a run without bytes, those that were not to be sorted as unequal."""
    spark = coded.sparkSession
    sorted_runs = coded.filter(F.col("kind") == _RUN)
    total, sampled = sorted_runs.agg(F.sum(F.size("h")), F.sum(F.size("sample"))).first()
    total, sampled = total or 0, sampled or 0
    ranges, splitters = min(max(1, -(-total // RANGE), min(parallelism(spark), total // 4096)), max(1, sampled)), []
    if ranges > 1:
        placed = prefix_sums(sorted_runs.select(F.explode("sample").alias("s"), F.lit(1).alias("one")), [], ["s"], "one")
        cuts = placed.filter(F.expr(f"_index > 0 and _index * {ranges} div {sampled} <> (_index - 1) * {ranges} div {sampled}"))
        splitters = sorted({bytes(r.s) for r in cuts.select("s").collect()})  # one for each range
    merged = _cut_runs(sorted_runs, splitters).groupBy("range").applyInArrow(_merge_range, _ROW)
    again = coded.filter(F.col("kind") == _AGAIN).select(F.explode(F.arrays_zip(*_WHO)).alias("x")).select("x.*", F.lit(True).alias("equal"), F.lit(False).alias("lead"), F.lit(None).cast("binary").alias("bytes"))
    return merged.unionByName(again).unionByName(_unbagged(coded.filter(F.col("kind") == _OPEN)))


_WANTED = ["at", "piece", "settled", "n"]


def _cut_contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sorted runs of the contexts ``wanted`` (h, h2, at, piece, settled, n): those with n > 1 are sorted."""
    wanted_lists = wanted.groupBy("h", "h2").agg(F.collect_list(F.struct(*_WANTED)).alias("list"))  # of one text: bounded by its length

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bytes, tuple]]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            items, edge = lists(batch.column(3))
            at, piece, settled, n = (items.field(c).to_pylist() for c in _WANTED)
            _, first, last = _unpacked(items.field("at").to_numpy())
            row = np.repeat(np.arange(batch.num_rows), np.diff(edge))
            begin, end = (offsets[row] + first).tolist(), (offsets[row] + last + LENGTH).tolist()
            h, h2, data = batch.column(0).to_numpy()[row].tolist(), batch.column(1).to_numpy()[row].tolist(), raw.tobytes()
            for i in range(len(at)):
                yield n[i] > 1, data[begin[i] : end[i]], (h[i], h2[i], at[i], piece[i], settled[i])

    joined = texts.select("h", "h2", "text").join(wanted_lists, ["h", "h2"]).select("h", "h2", "text", "list")
    return joined.mapInArrow(lambda batches: _sorted_runs(rows(batches)), _CODED)


def _cut_blocks(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sorted runs of the blocks or starts ``wanted`` (with ``seg``, the segment or block that holds each)."""
    joined = wanted.join(segments.select("h", "h2", F.col("at").alias("seg"), "bytes"), ["h", "h2", "seg"])
    inside = F.expr(f"int(at div {_PACK * _PACK} - (seg div {_PACK * _PACK} - seg div {_PACK} % {_PACK}))")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bytes, tuple]]:
        for batch in batches:
            for n, data, *who in zip(*(c.to_pylist() for c in batch.columns)):
                yield n > 1, data, tuple(who)

    cut = joined.select("n", F.substring("bytes", inside + 1, F.expr(f"int(at % {_PACK})") + LENGTH).alias("bytes"), *_WHO)
    return cut.mapInArrow(lambda batches: _sorted_runs(rows(batches)), _CODED)


def _start_rows(blocks_: DataFrame, bits: int) -> DataFrame:
    """Every start of some blocks by itself, with the hash of its ``LENGTH`` bytes as the piece."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = utf8(batch.column(4))
            at = batch.column(2).to_numpy()
            _, first, last = _unpacked(at)
            n = last - first + 1
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            piece = Rolling(raw).of(offsets[row] + step, offsets[row] + step + LENGTH)
            h, h2 = (batch.column(c).to_numpy()[row] for c in range(2))
            settled = batch.column(3).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (_masked(piece, bits), np.zeros(len(row), np.int64), h, h2, (first[row] + step) * _PACK * _PACK, at[row], settled))], names=["piece", "context", "h", "h2", "at", "seg", "settled"])

    return blocks_.select("h", "h2", "at", "settled", "bytes").mapInArrow(find, "piece long, context long, h long, h2 long, at long, seg long, settled boolean")


def _settle(rows: DataFrame, cut) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One level: rows (piece, context, h, h2, at, settled, ...) are counted by hash, ``cut`` to strings, sorted and merged.

    Returns the rows found equal to others, the strings that the next level needs (unequal ones, and one of each equal class that shares its
    piece with an unequal one), and the stored tables behind both.
    """
    counted = rows.groupBy("piece", "context").agg(F.count(F.lit(1)).alias("n"), F.min("settled").alias("settled"))
    counted = stored(counted, "classes")
    is_open = (F.col("n") == 1) & ~F.col("settled")
    pieces = stored(counted.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.sum(is_open.cast("int")).alias("open")).filter("n > 1 and open > 0").select("piece", "n"), "pieces")
    single = _spread(counted.filter("n = 1").select("piece", "context"), pieces, ["piece"], ["context"]).withColumn("n", F.lit(1).cast("long"))
    keys = stored(counted.filter("n > 1 and not settled").select("piece", "context", "n").unionByName(single.select("piece", "context", "n")), "keys")
    coded = stored(cut(_spread(rows, keys, ["piece", "context"], ["h", "at"], "inner")), "runs", TEXTS)
    merged = stored(_merge_sort(coded), "merged")
    for table in (counted, pieces, keys, coded):
        discard(table)
    left = merged.filter("lead").select(*_WHO[:4], (F.col("settled") | F.col("equal")).alias("settled"), "bytes")
    needed = stored(left.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("settled")).cast("int")).alias("open")).filter("n > 1 and open > 0").select("piece", "n"), "needed")
    return merged.filter("equal and not settled").select("h", "h2", "at"), _spread(left, needed, ["piece"], ["h", "at"]).select(*_WHO, "bytes"), [merged, needed]


def _starts(rows: DataFrame) -> DataFrame:
    """``h, h2, first, last`` of the starts that a packed ``at`` stands for."""
    first = F.expr(f"at div {_PACK * _PACK} - at div {_PACK} % {_PACK}")
    return rows.select("h", "h2", first.alias("first"), (first + F.expr(f"at % {_PACK}")).alias("last"))


def repeated_starts(texts: DataFrame, bits: int = 64) -> DataFrame:
    """``h, h2, first, last``: ranges of starts whose ``LENGTH`` bytes also start elsewhere in the distinct ``texts`` (h, h2, text). Written once; what led to it goes.

    ``bits`` of the hashes are used; fewer make more candidates for the merge and no other result.
    """
    long = texts.filter(F.octet_length("text") >= LENGTH)
    rows = _anchor_rows(long, bits)
    repeated = stored(rows.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "pieces")
    shared = stored(_spread(rows, repeated, ["piece"], ["h", "at"]).distinct().withColumn("settled", F.lit(False)), "anchors", TEXTS)
    discard(repeated)
    distinct = long.groupBy("h", "h2").agg(F.first("text").alias("text"))
    contexts, open_contexts, first_tables = _settle(shared, lambda wanted: _cut_contexts(distinct, wanted))
    discard(shared)
    segments = stored(open_contexts, "segments")
    parts = stored(_block_rows(segments, bits), "blocks", TEXTS)
    blocks_, open_blocks, second_tables = _settle(parts, lambda wanted: _cut_blocks(segments, wanted))
    open_blocks = stored(open_blocks, "open")
    discard(segments)
    discard(parts)
    each = stored(_start_rows(open_blocks, bits), "starts", TEXTS)
    starts, _, last_tables = _settle(each, lambda wanted: _cut_blocks(open_blocks, wanted))
    out = stored(_starts(contexts.unionByName(blocks_).unionByName(starts)), "repeated")
    for table in (*first_tables, *second_tables, *last_tables, open_blocks, each):
        discard(table)
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, spans, kept_sha256``; ``spans`` are the maximal removed byte ranges.

    Null and empty texts: no bytes, no spans. Texts shorter than ``LENGTH`` bytes: nothing is removed. Equal texts of at least that
    length: all bytes of every copy go. Repeats inside one text count; matches never cross texts. Texts are told apart by
    two 64-bit hashes. Empty table: no rows. Other columns play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"))
    marks = repeated_starts(named, bits).groupBy("h", "h2").agg(F.collect_set(F.struct("first", "last")).alias("marks"))  # of one text
    distinct = named.groupBy("h", "h2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    found = distinct.join(marks, ["h", "h2"], "left").select("h", "h2", "text", "copies", "marks")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            n, spans, kept = [], [], []
            items, edge = lists(batch.column(4))
            first, last = items.field("first").to_numpy(), items.field("last").to_numpy() + LENGTH
            for i, copies in enumerate(batch.column(3).to_pylist()):
                data = raw[offsets[i] : offsets[i + 1]]
                depth = np.zeros(len(data) + 1, np.int64)
                if copies > 1 and len(data) >= LENGTH:
                    depth[0], depth[-1] = 1, -1
                np.add.at(depth, first[edge[i] : edge[i + 1]], 1)
                np.add.at(depth, last[edge[i] : edge[i + 1]], -1)
                gone = np.cumsum(depth[:-1]) > 0
                n.append(len(data))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(*runs(gone))])
                kept.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], names=["h", "h2", "n_bytes", "spans", "kept_sha256"])

    digests = found.mapInArrow(remove, "h long, h2 long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string")
    digests = stored(digests, "digests", TEXTS)
    return named.select("doc_id", "h", "h2").join(digests, ["h", "h2"]).select("doc_id", "n_bytes", "spans", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
