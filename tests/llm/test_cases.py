"""Damaged files, gradients, base spans against a plain scan, held-out recall, clashing names, ids of other types, and each pipeline stage against a plain version."""

import hashlib
import random
import re
import string
import struct
import zlib
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontam, mixing, quality_mil, secrets, simhash, tiff, toxicity

from test_operators import SCHEMA, brute_simhash, hard_rows, prose, tables, docs, empty  # noqa: F401


def test_damaged_tiff_files_are_errors_and_no_row_is_lost(spark):
    image = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    good = tiff.encode([image])

    def changed(tag, value):
        blob = bytearray(good)
        at = struct.unpack_from("<I", blob, 4)[0]
        for i in range(struct.unpack_from("<H", blob, at)[0]):
            if struct.unpack_from("<H", blob, at + 2 + 12 * i)[0] == tag:
                struct.pack_into("<I", blob, at + 2 + 12 * i + 8, value)
        return blob

    bad = [changed(tiff.WIDTH, 0), changed(tiff.HEIGHT, 0), changed(tiff.HEIGHT, 1 << 31), changed(tiff.ROWS, 0), changed(tiff.ROWS, 1), changed(tiff.COMPRESSION, 77), good[:-6], good[:9], b"II*\0", b"", changed(tiff.COUNTS, 3)]
    count = bytearray(good)
    struct.pack_into("<I", count, struct.unpack_from("<I", count, 4)[0] + 2 + 4, 0xFFFFFFFF)
    rng = random.Random(1)
    noise = [bytes(b ^ (rng.random() < 0.02) * rng.randrange(256) for b in good) for _ in range(200)]
    rows = [(i, bytearray(b)) for i, b in enumerate([*bad, count, *noise])]
    got = {r.id: r for r in tiff.decoded(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].error and got[i].pages is None for i in range(len(bad) + 1))
    assert zlib.decompressobj().decompress(zlib.compress(bytes(1 << 20)), 10) == tiff._inflate(zlib.compress(bytes(1 << 20)), 10)


def test_tiff_digests(spark, tables):  # noqa: F811
    """Every coding of ``stored_as`` occurs; stored bytes, their digest and the feature agree with a plain computation."""
    texts = Counter(((r[1] or "").encode(), r[0]) for r in hard_rows())
    want = Counter()
    for (t, i), n in texts.items():
        blob = tiff.encode(tiff.text_images(t), **tiff.stored_as(t))
        pixels = np.frombuffer(tiff.payload(t), np.uint8)
        half_up = lambda x: Decimal(float(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
        feature = f"64x{len(pixels) // 192}x3:{half_up(pixels.mean())}:{half_up(pixels.std())}:{len(set(pixels.tolist()))}"
        want[i, len(blob), hashlib.sha256(blob).hexdigest(), feature] += n
    assert Counter((r.doc_id, r.media_bytes, r.media_sha256, r.feature) for r in tiff.query(spark, tables).collect()) == want
    kinds = [tiff.stored_as(str(i).encode()) for i in range(400)]
    assert {k["compression"] for k in kinds} == {tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS} and {k["order"] for k in kinds} == {"<", ">"} and {k["predictor"] for k in kinds} == {1, 2}
    long = ("long " * 400_000).encode()
    assert b"".join(p.tobytes() for p in tiff.pages(tiff.encode(tiff.text_images(long)))) == tiff.payload(long)


def test_attention_gradients_and_forward_pass():
    rng = np.random.default_rng(2)
    model = quality_mil.GatedAttention()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    first = np.array([0, 1, 4, 9])
    x, y = rng.random((9, quality_mil.N_FEATURES)), np.array([1.0, 0.0, 1.0])
    model.mean, model.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.1)
    scores = []
    for a, b in zip(first[:-1], first[1:]):  # one document at a time, one passage at a time
        h = [np.tanh(((row - model.mean) * model.scale) @ model.p["W"] + model.p["b"]) for row in x[a:b]]
        s = np.array([model.p["w"] @ (np.tanh(v @ model.p["V"]) / (1 + np.exp(-(v @ model.p["U"])))) for v in h])
        weight = np.exp(s) / np.exp(s).sum()
        scores.append(1 / (1 + np.exp(-(sum(w * v for w, v in zip(weight, h)) @ model.p["c"] + model.p["d"][0]))))
    np.testing.assert_allclose(model.forward(x, first)["y"], scores, rtol=1e-9)
    loss = lambda: -np.mean(y * np.log(model.forward(x, first)["y"]) + (1 - y) * np.log(1 - model.forward(x, first)["y"]))
    found = model.gradients(x, first, y)
    for name, value in model.p.items():
        for i in [np.unravel_index(j, value.shape) for j in rng.choice(value.size, min(6, value.size), replace=False)]:
            kept = value[i]
            value[i] = kept + 1e-5
            up = loss()
            value[i] = kept - 1e-5
            down = loss()
            value[i] = kept
            assert abs((up - down) / 2e-5 - found[name][i]) < 1e-6, name


def test_words_reach_the_encoder():
    """Two texts of the same byte classes and other words differ in the word buckets alone."""
    features = [quality_mil.passages(*(lambda raw: (raw, np.array([0, len(raw)])))(np.frombuffer(t, np.uint8)))[0][0] for t in (b"able acid aged", b"zinc zone zero")]
    assert np.allclose(features[0][:259], features[1][:259]) and not np.allclose(features[0][259:], features[1][259:])


@pytest.mark.parametrize("values", [[None] * 40, [1] * 40, [0] * 40])
def test_labels_of_one_kind_or_none(spark, values):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, prose(rng, 9), "en", "s", 0) for i in range(40)], SCHEMA)  # noqa: F811
    labels = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_mil.quality_scores(docs, labels).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity_scores(docs, labels).collect()} == {0.0}
    assert quality_mil.accepted(docs, labels).count() == 40


def plain_base_spans(text):
    """The base patterns by a scan from left to right, character by character."""
    out = []
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    i = 0
    while i < len(text):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[i : i + len(word)]) != word:
                continue
            j = i + len(word)
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "="):
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            k = j
            while text[k : k + 1] and text[k] in value:
                k += 1
            if k > j:
                if k - j >= 8:
                    out.append((i, k, "assign"))
                i = k - 1
                break
        i += 1
    for kind, head, body, least in (("access", "AKIA", set(string.ascii_uppercase + string.digits), 16), ("hex", "", set("0123456789abcdef"), 32)):
        i = 0
        while i < len(text):
            k = i + len(head)
            if text[i:k] == head and text[k : k + 1] in body and text[k : k + 1]:
                while text[k : k + 1] and text[k] in body:
                    k += 1
                if k - i >= least:
                    out.append((i, k, kind))
                i = k
            else:
                i += 1
    return out


def test_base_spans_against_a_plain_scan(spark):
    rng = random.Random(5)
    parts = ["password", "PASSWD", "Secret", "tokEN", "api_key", "apikey", "ſecret", "=", ":", " ", "'", '"', "AKIA", "AKIAAKIA", "A1B2C3D4E5F6G7", "abcdef0123456789", "0f" * 9, "0F" * 9, "xyz", "\n", "é", ".", "a" * 8, "=="]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(1500)]
    for t in texts:
        assert sorted(secrets.base_spans(t)) == sorted(plain_base_spans(t)), t
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    for r in secrets.secret_scan(rows).collect():
        assert [(s.start, s.end, s.kind) for s in r.spans if s.kind != "random"] == sorted(plain_base_spans(texts[int(r.doc_id)]), key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secret_models_on_strings_they_have_not_seen():
    """Recall by alphabet, and false positives on ordinary strings, with other seeds and words than in training."""
    model, rng = secrets.RandomStrings(*secrets.labelled_samples([])), random.Random(77)
    for alphabet, least in (("0123456789abcdef", 0.95), (string.ascii_uppercase + "234567", 0.95), (string.ascii_letters + string.digits, 0.95), (string.ascii_letters + string.digits + "+/", 0.95)):
        made = ["".join(rng.choices(alphabet, k=rng.randrange(20, 50))) for _ in range(1000)]
        assert np.mean([bool(model.spans(s)) for s in made]) >= least, alphabet
    words = "platform support list default render engine session cookie header timeout retry buffer layout screen module import export".split()
    ordinary = ["_".join(rng.choices(words, k=4)) for _ in range(300)] + ["_".join(rng.choices(words, k=4)).upper() for _ in range(300)] + ["/".join(rng.choices(words, k=5)) for _ in range(300)]
    assert np.mean([bool(model.spans(s)) for s in ordinary]) <= 0.02
    assert not any(model.spans(c * n) for c in "-=_.a" for n in (20, 40, 80))


def test_names_that_operators_use_may_clash(spark):
    names = ["_id", "_source", "_md5", "_times", "_hash", "_rows", "_text_md5", "row", "n", "id", "hash", "md5", "times", "more", "n_rows", "one", "_index", "_key", "_before", "_part", "_tie", "a.b"]
    rng = random.Random(3)
    rows = [(i, prose(rng, 30), "en", "s", 0) for i in range(30)] * 2
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in names})
    for made in (mixing.mixed_rows(wide), simhash.one_of_each(wide)):
        assert made.columns == wide.columns and made.count() > 0
        assert made.filter("_id <> 'clash' or hash <> 'clash'").count() == 0
    assert simhash.one_of_each(wide).count() == len({r[0] for r in rows})


def test_ids_of_text(spark):
    rng = random.Random(3)
    few = spark.createDataFrame([(f"d{i}", prose(rng, 30) + " x" * (i % 3), "en", "s", 0) for i in range(20)] + [(None, "", None, None, None)], SCHEMA.replace("doc_id long", "doc_id string"))
    labels = spark.createDataFrame([(f"d{i}", i % 2, i % 3 == 0) for i in range(20)], "doc_id string, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    items = spark.createDataFrame([("b", "alpha beta")], "item_id string, text string")
    for made in (tiff.text_media(few), toxicity.toxicity_scores(few, labels), quality_mil.quality_scores(few, labels), decontam.scan(few, items), decontam.remove_spans(few, items), secrets.secret_scan(few), simhash.near_duplicates(few), mixing.mix(few)):
        assert Counter(r.doc_id for r in made.collect()) == Counter(r.doc_id for r in few.collect())


def test_equal_rows_may_lie_across_the_end_of_the_budget(spark):
    """A third of a source is one row again and again: its taken words still come within half a document of the target."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 20), "en", "ab"[i % 2], 0) for i in range(200)] + [(7, "same words " * 5, "en", "b", 0)] * 60
    table = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix(table).toPandas()
    by = (plan["size"] * (plan.times * plan.n_rows + plan.more)).groupby(plan.source).sum()
    target = plan.groupby("source").target.first()
    assert (abs(by - target) <= 10).all()
    made = Counter(r.source for r in mixing.mixed_rows(table).select("source", F.explode(F.split("text", " +"))).filter("col <> ''").collect())
    assert {k: int(v) for k, v in by.items()} == dict(made)


def test_pipeline_against_plain_stages(spark, tables):  # noqa: F811
    pipeline = pytest.importorskip("corpus_pipeline")
    labels, benchmark = spark.read.parquet(f"{tables}/labels.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    docs = spark.read.parquet(f"{tables}/documents.parquet")  # noqa: F811
    key = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    stages = [f for _, f in pipeline.STAGES]
    model = quality_mil.fit(docs, labels)
    score = lambda t: model.score(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
    first = stages[0](spark, docs, tables)
    margin = [k for k in key(docs) if abs(score(k[1]) - quality_mil.THRESHOLD) > 1e-6]
    got = key(first)
    wrong = [(k[0], len(k[1] or ""), score(k[1]), k in got) for k in margin if (k in got) != (score(k[1]) >= quality_mil.THRESHOLD)]
    assert not wrong
    second = stages[1](spark, docs, tables)
    rows = list(key(docs))
    prints = [brute_simhash(k[1]) for k in rows]
    group = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min(group[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(rows))]
        if new == group:
            break
        group = new
    ids = {}
    for g, k in zip(group, rows):
        if k[0] is not None:
            ids[g] = min(ids.get(g, k[0]), k[0])
    assert sorted(r.doc_id for r in second.collect()) == sorted(ids[g] for g in set(group))
    third = stages[2](spark, docs, tables)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = [words(r.text) for r in benchmark.collect()]
    grams = {tuple(b[i : i + min(10, len(b))]) for b in items if b for i in range(len(b) - min(10, len(b)) + 1)}
    dirty = lambda t: any(tuple(words(t)[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(words(t)) - n + 1))
    assert key(third) == Counter({k: n for k, n in key(docs).items() if not dirty(k[1])})
    fourth = stages[3](spark, docs, tables)
    plan = mixing.mix(docs).collect()
    assert fourth.count() == sum(r.n_rows * r.times + r.more for r in plan)
    last = stages[4](spark, fourth, tables).collect()
    total = sum(r["size"] for r in last)
    order = sorted(last, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]))
    before, where = 0, Counter()
    for r in order:
        where[r.doc_id, r.text_crc32, (2 * before + r["size"]) * 8 // (2 * total)] += 1
        before += r["size"]
    assert where == Counter((r.doc_id, r.text_crc32, r.shard) for r in last)


def test_one_long_text_does_not_empty_the_sample(spark):
    """A bound in bytes leaves out what is too long alone and keeps the rest; where all are, the shortest stays."""
    from graphloom.llm._labels import held_out, labelled_texts

    ids = [r.i for r in spark.range(400).select(F.col("id").alias("i"), held_out(F.col("id")).alias("h")).filter("not h").collect()]
    first = [r.i for r in spark.createDataFrame([(i,) for i in ids], "i long").orderBy(F.xxhash64("i")).limit(1).collect()][0]
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    texts = [(i, "x" * (200_000 if i == first else 100)) for i in ids]
    got = labelled_texts(spark.createDataFrame(texts, "doc_id long, text string"), labels, "toxic", 1000, 100_000).collect()
    assert {r.doc_id for r in got} == set(ids) - {first}
    few = labelled_texts(spark.createDataFrame(texts, "doc_id long, text string"), labels, "toxic", 1000, 1000).collect()
    assert 8 <= len(few) <= 10
    long = labelled_texts(spark.createDataFrame([(i, "x" * (5000 + i)) for i in ids], "doc_id long, text string"), labels, "toxic", 1000, 1000).collect()
    assert [r.doc_id for r in long] == [min(ids)]


def test_pages_with_clashing_names(spark):
    blob = bytearray(tiff.encode(tiff.text_images(b"some text")))
    frame = spark.createDataFrame([(1, blob, 7, 8, 9), (2, bytearray(b"none"), 7, 8, 9), (3, None, 7, 8, 9)], "id int, media binary, _p int, `a.b` int, row int")
    got = tiff.tiff_pages(frame).collect()
    assert [(r["id"], r["_p"], r["a.b"], r["row"], r["page"]) for r in got] == [(1, 7, 8, 9, 0)]
    assert [r.error is None for r in tiff.decoded(frame).orderBy("id").collect()] == [True, False, True]
