"""Personal data, hard negatives and importance draws against brute-force versions, and on hard rows: nulls, empty and long texts, ties, repeats, no rows, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hard_negatives, importance, pii

from test_operators import SCHEMA, docs, empty, hard_rows, prose, tables  # noqa: F401

WORDS = "river stone cloud paper light house green seven window garden market winter".split()


# Importance draws


def word_runs(text, shortest, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for i in range(len(words)) for n in range(shortest, longest + 1) if i + n <= len(words)]


@pytest.mark.parametrize("shortest,longest", [(1, 1), (1, 3), (2, 2), (3, 4)])
def test_ring_emits_every_run(shortest, longest):
    for text in ("", "A", "One, TWO three-four", "é über 7 naïve Σ" * 9, prose(random.Random(1), 300)):
        words, runs = word_runs(text, shortest, longest)
        n, found = importance.ring_buckets(text.encode(), shortest, longest, 97)
        assert n == len(words) and Counter(found) == Counter(zlib.crc32(r.encode()) % 97 for r in runs)


def brute_draw(rows, targets, shortest=1, longest=1, buckets=10_000, least=20, per_cent=10, seed=2024):
    def hits(text):
        return Counter(zlib.crc32(r.encode()) % buckets for r in word_runs(text, shortest, longest)[1])

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(hits(text))
    for text in targets:
        t.update(hits(text))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    out = []
    for i, text in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in hits(text).items())
        out.append([i, sum(hits(text).values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(word_runs(text, 1, 1)[0])])
    ranked = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(ranked[: len(ranked) * per_cent // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


def test_draw_equals_brute_force(spark, tables):  # noqa: F811
    targets = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    got = Counter(tuple(r) for r in importance.query(spark, tables).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == brute_draw([(r[0], r[1]) for r in hard_rows()], targets)


def test_longer_runs_more_drawn_and_clashing_names(spark, docs):  # noqa: F811
    target = spark.createDataFrame([("river stone cloud",), (None,)], "text string")
    frame = docs.select("*", F.lit(1).alias("hits"), F.lit(2).alias("rank"), F.lit(3).alias("_low"), F.lit(4).alias("a.b"))
    found = importance.resampled(frame, target, shortest=1, longest=3, n_buckets=50, least_words=5, per_cent=40, seed=7)
    assert Counter(tuple(r) for r in found.collect()) == brute_draw([(r[0], r[1]) for r in hard_rows()], ["river stone cloud", None], 1, 3, 50, 5, 40, 7)


def test_draw_without_rows_or_target(spark, empty, docs):  # noqa: F811
    assert importance.query(spark, empty).collect() == []
    nothing = spark.createDataFrame([], "text string")
    assert Counter(tuple(r) for r in importance.resampled(docs, nothing).collect()) == brute_draw([(r[0], r[1]) for r in hard_rows()], [])


# Hard negatives


def brute_negatives(rows):
    ok = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, va in ok:
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(va, v)), i, label) for i, label, v in ok if i != a]
        for ps, p, _ in sorted(s for s in scored if s[2] == la)[:5]:
            fits = sorted(s for s in scored if s[2] != la and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:5]
            out += [(a, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits, 1)]
    return Counter(out)


VECTORS = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("width", [3, 12, 40])
def test_negatives_equal_brute_force(spark, width):
    rng = np.random.default_rng(width)
    centre = rng.normal(size=(4, width))
    rows = [(i, int(i % 4), (centre[i % 3] * 0.2 + rng.normal(size=width) * 0.1).tolist()) for i in range(700)]
    rows += [(1000 + i, 1, rows[100][2]) for i in range(30)] + [(1100 + i, 2, rows[100][2]) for i in range(30)]  # ties
    rows += [(None, 1, rows[0][2]), (2000, None, rows[0][2]), (2100, 1, None), (2200, 1, [None, *rows[0][2][1:]]), (2300, 1, [float("nan"), *rows[0][2][1:]]), (2400, 1, [float("inf")] * width)]
    rows += [(2500, 3, []), (2600, 3, rows[0][2][:2]), (2700, 0, [0.0] * width), (2800, 9, rows[1][2]), (2900, 3, [-x for x in rows[2][2]]), rows[200], rows[301]]
    frame = spark.createDataFrame(rows, VECTORS).repartition(5).select("*", F.lit(1).alias("no"), F.lit(2).alias("whole"), F.lit(3).alias("a.b"))
    assert Counter(tuple(r) for r in hard_negatives.hard_negatives(frame).collect()) == brute_negatives(rows)


def test_negatives_in_blocks_and_of_large_components(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i * 25, int(i % 2), (rng.normal(size=10) * (1e9 if i % 7 == 0 else 1)).tolist()) for i in range(160)]
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 7)
    want = brute_negatives(rows)
    top = (1 << 63) - 1
    clipped = Counter({(*k[:4], *(max(-top, min(top, x)) for x in k[4:])): n for k, n in want.items()})
    got = Counter(tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect())
    small = lambda c: Counter({k: n for k, n in c.items() if max(abs(k[4]), abs(k[5])) < top})
    assert small(got) == small(clipped) and len(small(got)) > 20


def test_bounds_discard_early_and_never_too_much():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(300, 64)) * np.geomspace(60, 1, 64))
    _, axes = np.linalg.eigh(x.T @ x)
    side = hard_negatives.Side.of(np.arange(300), np.zeros(300, np.int64), x, axes[:, ::-1])
    exact = x @ x.T
    low = np.sort(exact, axis=0)[-6].astype(np.int64)
    i, j, score = hard_negatives.survivors(side, side, np.ones((300, 300), bool), low, np.full(300, hard_negatives._TOP))
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(exact >= low))) and (score == exact[i, j]).all()
    part = side.rotated[:, :8] @ side.rotated[:, :8].T + np.outer(side.tails[0], side.tails[0])
    assert (part >= low).mean() < 0.5


def test_negatives_query_and_no_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 10), rng.normal(size=16).astype(np.float32).tolist()) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    assert Counter(tuple(r) for r in hard_negatives.query(spark, str(tmp_path)).collect()) == brute_negatives(moved)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(0, 1, [1.0]), (7, 1, None)], VECTORS)).collect() == []


# Personal data


def plain_base(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    alphabets = ["0123456789. -+()@ab", "01.@a-", "25.", "0123456789 -", "+0123456789()- .", "a.@-b", "é٣²1.@+"]
    for _ in range(20_000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randrange(60)))
        assert sorted(pii.base_spans(text)) == plain_base(text), text


@pytest.fixture(scope="module")
def model():
    return pii.SemiMarkov().learn(pii.labelled(pii.made_up(WORDS)))


def segmentations(s):
    by_start = defaultdict(list)
    for i, length, features, allowed in s.segments:
        for y in allowed:
            by_start[i].append((i, length, y, features))

    def further(at):
        if at == len(s.ends):
            yield []
        for seg in by_start[at]:
            for rest in further(at + seg[1]):
                yield [seg, *rest]

    return list(further(0))


def path_score(m, path):
    labels = [0, *(seg[2] for seg in path)]
    return sum(m.weights[y, f].sum() for _, _, y, f in path) + sum(m.follows[a, b] for a, b in itertools.pairwise(labels))


def test_sums_gradient_and_best_path_equal_enumeration():
    rng = np.random.default_rng(5)
    data = [d for d in pii.labelled(pii.made_up(WORDS, 300, seed=4)) if len(d[0].ends) <= 12][:12]
    assert len(data) == 12 and any(y for _, gold in data for _, _, y in gold)
    m = pii.SemiMarkov(rng.normal(size=(pii.LABELS, pii.FEATURES)) * 0.5, rng.normal(size=(pii.LABELS, pii.LABELS)))
    parts = m.lattice(data)
    value, grad, follow_grad = m.likelihood(data, *parts)
    want = []
    for s, gold in data:
        paths = segmentations(s)
        scores = np.array([path_score(m, p) for p in paths])
        right = next(x for p, x in zip(paths, scores) if {seg[:3] for seg in p} == gold)
        want.append(right - (np.log(np.exp(scores - scores.max()).sum()) + scores.max()))
        top = paths[int(scores.argmax())]
        starts = [s.start, *s.ends]
        assert m.decode(s, margin=0.0) == [(starts[i], s.ends[i + n - 1], pii.KINDS[y - 1]) for i, n, y, _ in top if y]
    assert value == pytest.approx(np.mean(want))
    for values, g in ((m.weights, grad), (m.follows, follow_grad)):
        for at in list(zip(*np.nonzero(np.abs(g) > 1e-3)))[:: max(1, int((np.abs(g) > 1e-3).sum() // 12))]:
            values[at] += 1e-5
            up = m.likelihood(data, *parts)[0]
            values[at] -= 2e-5
            down = m.likelihood(data, *parts)[0]
            values[at] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_held_out_spans(model):
    """Other seeds than learned from. Base spans stay, so precision is that of the added ones."""
    found, known, right, added = 0, 0, 0, 0
    for text, spans in pii.made_up(WORDS, 800, seed=77):
        got = pii.personal_spans(text, model)
        want = set(spans)
        known += len(want)
        found += len(want & {s[:3] for s in got})
        added += sum(not s[3] for s in got)
        right += sum(not s[3] and s[:3] in want for s in got)
    assert found / known > 0.88 and right / added > 0.97


def test_side_by_side_and_spelled_out(model):
    card = "4539148803436467"
    for text, want in (
        ("Oring +1 (477) 555-4197 4539148803436467 the", [("phone", "+1 (477) 555-4197"), ("card", card)]),
        ("12.158.146.200 4539148803436467 river", [("ip", "12.158.146.200"), ("card", card)]),
        ("write stone.river (at) garden (dot) org today", [("email", "stone.river (at) garden (dot) org")]),
        ("river 9597024294303453 stone 2024-05-17 12:30:11", []),
        ("", []),
    ):
        found = {(k, text[a:b]) for a, b, k, _ in pii.personal_spans(text, model)}
        assert (set(want) <= found) if want else not found, (text, found)


def test_added_spans_never_overlap(model):
    rng = random.Random(8)
    texts = ["".join(rng.choices("0123456789 .-+()/@a", k=400)) for _ in range(60)] + ["1 " * 4000, "1" * 50_000, "a@" * 3000, "+1 (477) 555-4197 " * 300]
    for text in texts:
        got = pii.personal_spans(text, model)
        assert sorted(s[:3] for s in got if s[3]) == plain_base(text)
        ends = 0
        base = [s for s in got if s[3]]
        for a, b, _, _ in sorted(s for s in got if not s[3]):
            assert a >= ends and all(b <= x or a >= y for x, y, *_ in base)
            ends = b


def test_personal_data_query(spark, tables, empty, monkeypatch):  # noqa: F811
    got = pii.query(spark, tables).collect()
    assert Counter((r.doc_id, r.spans) for r in got) == Counter((r[0], ",".join(f"{k}:{a}:{b}" for a, b, k in plain_base(r[1] or ""))) for r in hard_rows())
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got)
    assert pii.query(spark, empty).collect() == []


def test_personal_data_of_hard_rows(spark, model):
    rows = [(1, None, 0), (2, "", 0), (3, "a.b@c.de +1 (477) 555-4197 4539148803436467", 0), (3, "a.b@c.de +1 (477) 555-4197 4539148803436467", 0), (None, "1.2.3.4", 0), (5, "x" * 300_000 + " 1.2.3.4", 0)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, spans int").select("*", F.lit(1).alias("a.b"))
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.end, s.base) for s in r.spans)) for r in pii.personal_data(frame, model).collect())
    twice = (("email", 0, 8, True), ("phone", 9, 26, False), ("card", 27, 43, False))
    assert got == Counter({(1, ()): 1, (2, ()): 1, (3, twice): 2, (None, (("ip", 0, 7, True),)): 1, (5, (("ip", 300_001, 300_008, True),)): 1})
