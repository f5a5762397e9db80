"""Every operator against a brute-force version, an exact round trip or held-out labels, and on hard rows: nulls, empty and long texts, ties, repeats, no rows, clashing names."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import decontam, licenses, mixing, quality_mil, secrets, sharding, simhash, suffix_dedup, tiff, toxicity

WORDS = "alpha beta gamma delta omega river stone cloud paper light house green seven éclair naïve über".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(",.") if rng.random() < 0.1 else "") for _ in range(n))


def hard_rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    texts = [None, "", " \n\t ", "x", "A", base[0], base[0], base[0], prose(rng, 6000), "a" * 900, "é" * 300, *base]
    for t in base[:10]:
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
        texts.append(prose(rng, 30) + " " + t + " " + prose(rng, 30))
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base[1], None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = hard_rows()
    spark.createDataFrame([(r[0], r[0] % 2, int("changed" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [("b1", rows[12][1]), ("b2", "River, STONE cloud"), ("b3", ""), ("b4", None), ("b5", rows[8][1][:400])]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


MODULES = [tiff, toxicity, sharding, quality_mil, decontam, simhash, mixing, licenses, secrets, suffix_dedup]


@pytest.mark.parametrize("module", MODULES, ids=lambda m: m.__name__.rpartition(".")[2])
def test_every_row_comes_back(spark, tables, empty, module):
    got = module.query(spark, tables).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in hard_rows())
    assert module.query(spark, empty).count() == 0


@pytest.mark.parametrize("module", MODULES, ids=lambda m: m.__name__.rpartition(".")[2])
def test_clashing_columns(spark, tables, module, tmp_path):
    more = ["size", "shard", "slot", "h", "fp", "root", "text_hash", "score", "pages", "media", "_text_md5", "key", "count", "weight"]
    spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.lit("clash") for c in more}).limit(12).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert module.query(spark, str(tmp_path)).count() == 12


def test_tiff_round_trip(spark, tables):
    texts = {r[0]: (r[1] or "").encode() for r in hard_rows()}
    for r in tiff.query(spark, tables).collect():
        want = tiff.payload(texts[r.doc_id]) if r.doc_id is not None else None
        if want:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))


def test_tiff_compressions_and_damage(spark):
    image = np.random.default_rng(1).integers(0, 255, (133, 77, 3), dtype=np.uint8)
    for compression in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for predictor in (1, 2):
            for tile in (None, 32):
                for order in "<>":
                    a, b = tiff.pages(tiff.encode([image, image[:5]], compression, predictor, tile=tile, order=order))
                    assert (a == image).all() and (b == image[:5]).all()
    rng = random.Random(2)
    for n in (0, 1, 300, 9000):
        data = bytes(rng.choices(b"ab", k=n))
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.unpack_bits(tiff.pack_bits(data)) == data
    good = tiff.encode([image, image[:9]])
    media = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:50])), (3, None), (4, bytearray(b"no"))], "id long, media binary")
    opened = {r.id: r for r in tiff.decoded(media).collect()}
    assert len(opened[1].pages) == 2 and opened[2].error and opened[3].pages is None and opened[3].error is None and opened[4].error
    assert sorted((r.id, r.page, r.height) for r in tiff.tiff_pages(media).collect()) == [(1, 0, 133), (1, 1, 9)]


@pytest.mark.parametrize("frequent", [0.0, 0.1, 2.0])
def test_toxicity_index_is_exact(frequent):
    """With all, some and no terms in blocked lists."""
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        c = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        w = rng.random(len(c)) + 0.1
        vectors.append((c, w / np.sqrt((w**2).sum())))
    index = toxicity.BlockMaxIndex(vectors, 60, frequent)
    dense = np.zeros((700, 60))
    for i, (c, w) in enumerate(vectors):
        dense[i, c] = w
    every = np.array([dense[:, c] @ w for c, w in vectors[:80]])
    for (c, w), sims in zip(vectors[:80], every):
        ids, got = index.nearest(c, w, 10)
        np.testing.assert_allclose(got, np.sort(sims)[::-1][:10], atol=1e-8)
        assert (np.diff(got) <= 1e-8).all() and np.allclose(sims[ids], got, atol=1e-8)
    found, kth = index.similarities(vectors[:80], 10)
    for sims, got, least in zip(every, found, kth):
        near = sims >= least + 1e-8
        np.testing.assert_allclose(got[near], sims[near], atol=1e-8)  # all that are at least as near as the 10th have been scored
    if frequent < 1:
        assert index.visited < index.searched


def test_toxicity_scores_against_a_dense_version(spark):
    """Vectors, votes and calibration by plain loops over words."""
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(0, 40)) + (" vermin" if i % 4 == 0 else ""), "en", "s", 0) for i in range(150)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    words = {i: Counter(re.findall(r"[a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))) for i, t, *_ in rows}
    train = sorted((str(i) for i in range(120) if zlib.crc32(str(i).encode()) % 4 != 2))
    train = [int(i) for i in train]
    y = {i: int(i % 4 == 0) for i in train}
    vocabulary = sorted({w for i in train for w in words[i]})
    n, p = len(train), sum(y.values())
    scale = {}
    for w in vocabulary:
        a, k = sum(y[i] for i in train if w in words[i]), sum(w in words[i] for i in train)
        b, c, d = k - a, p - a, (n - p) - (k - a)
        chi2 = n * (a * d - b * c) ** 2 / (k * (c + d) * p * (n - p)) if c + d else 0.0
        factor = toxicity.PLAIN + math.sqrt(max(0.0, chi2 - 2 * math.log(max(2, len(vocabulary)))) / n)
        scale[w] = (math.log((1 + len(rows)) / (1 + sum(w in words[i] for i in words))) + 1) * factor

    def vector(i):
        v = {w: (1 + math.log(k)) * scale[w] for w, k in words[i].items() if w in scale}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    groups = defaultdict(list)
    for i in train:
        groups[tuple(sorted((w, round(x, 9)) for w, x in vector(i).items()))].append(i)
    bare = groups.pop((), [])
    kept = [(vector(g[0]), g) for g in groups.values()]
    base = (p + 0.5) / (n + 1)

    def vote(v, k, out=None):
        sims = [round(sum(x * g[w] for w, x in v.items() if w in g), 9) for g, _ in kept]
        least = sorted(sims, reverse=True)[k - 1] if len(sims) >= k else 0.0
        top = low = 0.0
        for s, (_, ids) in zip(sims, kept):
            if s <= 0 or s < least:
                continue
            count, positive = len(ids) - (out in ids), sum(y[j] for j in ids) - (y[out] if out in ids else 0)
            w = (1 / (1.05 - min(1, s))) * (min(count, 20) / count if count else 0)
            top, low = top + w * positive, low + w * count
        return (top + base) / (low + 1)

    edges, values = toxicity._rising([(vote(v, toxicity.NEIGHBOURS + 1, i), y[i]) for v, ids in kept for i in ids])
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    for i in words:
        v = vector(i) if any(w in scale for w in words[i]) else {}
        want = vote(v, toxicity.NEIGHBOURS) if v else (sum(y[j] for j in bare) + 2 * base) / (len(bare) + 2)
        if v and len(edges) > 1:
            want = float(np.interp(want, edges, values))
        assert abs(got[i] - want) < 1e-6, i


def test_scores_are_learned_from_other_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad, junk = i % 5 == 0, i % 3 == 0
        t = prose(rng, 40) + (" horrid vermin" if bad else "") + (" !!*** %%% ###" * 12 if junk else "")
        rows.append((i, t, "en", "s", 0))
        labels.append((i, int(not junk), int(bad)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    good = {r.doc_id: r.score for r in quality_mil.quality_scores(docs, labels).collect()}
    assert np.mean([(good[i] >= 0.7) == (i % 3 != 0) for i in kept]) > 0.95
    toxic = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert np.mean([(toxic[i].score >= 0.3) == (i % 5 == 0) for i in kept]) > 0.95
    assert all(e.label == 1 for e in toxic[kept[[k % 5 == 0 for k in kept].index(True)]].evidence)


def test_shards(spark, tables):
    got = sharding.query(spark, tables).toPandas()
    total = got["size"].sum()
    assert abs(got.groupby("shard")["size"].sum() - total / 8).max() <= got["size"].max()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_mixture(spark, docs, tables):
    got = mixing.query(spark, tables).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"), n=("target", "nunique"), large=("size", "max"))
    assert (abs(by[by.n == 1].taken - by[by.n == 1].target) <= by[by.n == 1].large * 2).all()
    again = mixing.query(spark, tables).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].fillna(-1).values.tolist())) == sorted(map(tuple, again[key].fillna(-1).values.tolist()))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    sizes = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows.collect())
    assert sizes == got.taken.sum()


def test_decontamination(spark, docs, tables, monkeypatch):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: word.findall((t or "").translate(low))
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()}

    def brute(text):
        w, hit, found = words(text), set(), set()
        for item, b in items.items():
            n = min(10, len(b))
            known = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in known:
                    hit |= set(range(i, i + n))
                    found.add(item)
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    want = Counter((r[0], *brute(r[1])) for r in hard_rows())
    assert sum(x[-1] for x in want) > 3
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(tuple(r) for r in decontam.query(spark, tables).select(*columns).collect()) == want
    benchmark = spark.read.parquet(f"{tables}/benchmark.parquet")
    clean = decontam.clean_documents(docs, benchmark)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in hard_rows() if not brute(r[1])[-1])
    assert all(not brute(r.text)[-1] or len(items["b2"]) < 10 for r in decontam.remove_spans(docs, benchmark).collect())
    monkeypatch.setattr(decontam, "BLOCK", 200)  # a benchmark in several blocks gives the same
    assert Counter(tuple(r) for r in decontam.query(spark, tables).select(*columns).collect()) == want


def brute_simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_decontamination_in_blocks_keeps_rows_apart(spark, monkeypatch):
    words = [f"word{i}" for i in range(60)]
    benchmark = spark.createDataFrame([(f"b{i}", " ".join(words[i : i + 10])) for i in range(0, 50, 5)], "item_id string, text string")
    texts = [" ".join(words), " ".join(f"clean{i}" for i in range(60)), " ".join(words[:20] + [f"other{i}" for i in range(40)]), None, "und " + " ".join(words[3:40])]
    rows = [(i, t) for t in texts for i in (None, None, 7)]
    few = spark.createDataFrame(rows, "doc_id long, text string")

    def results():
        found = decontam.scan(few, benchmark).collect()
        cut = decontam.remove_spans(few, benchmark).collect()
        return Counter(map(str, found)), Counter(tuple(r) for r in cut)

    whole = results()
    monkeypatch.setattr(decontam, "BLOCK", 200)
    assert results() == whole


def test_simhash(spark, docs, tables):
    rows = hard_rows()
    prints = [brute_simhash(r[1]) for r in rows]
    group = list(range(len(rows)))
    while True:
        new = [min(group[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(rows))]
        if new == group:
            break
        group = new
    ids = defaultdict(list)
    for g, r in zip(group, rows):
        ids[g].append(r[0])
    want = Counter((r[0], f"{p:016x}", min(i for i in ids[g] if i is not None)) for r, p, g in zip(rows, prints, group))
    assert Counter(tuple(r) for r in simhash.query(spark, tables).select("doc_id", "fingerprint", "component_id").collect()) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})


def test_simhash_links_random_near_prints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)  # full cells are many tiles
    rng = random.Random(4)
    prints = []
    for i in range(150):
        p = rng.getrandbits(64) if i % 2 else sum(1 << b + 16 * q for q in range(4) for b in rng.sample(range(16), 8))
        for _ in range(rng.randrange(1, 5)):
            prints.append(p)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                p ^= 1 << b
    links = simhash.near_links(spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long"))
    roots = {r.v & (1 << 64) - 1: r.root for r in simhash.components(links).collect()}
    u = sorted(set(prints))
    label = {p: p for p in u}
    for _ in range(10):
        for i, a in enumerate(u):
            for b in u[i + 1 :]:
                if (a ^ b).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    for a in u:
        for b in u:
            if label[a] == label[b] and a != b:
                assert roots[a] == roots[b]
    assert len({roots[a] for a in roots}) == len({label[a] for a in roots})


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, mit), (2, "Intro.\nLicensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://x"), (3, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (4, "see the GNU General Public License for more details."), (5, None)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(1, 6)] == ["MIT", "Apache-2.0", "MIT,CC-BY-NC-4.0", "", ""]
    assert got[4].unmatched == "<GPLSee>" and got[5].n_sentences == 0


def test_wrapped_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2) Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    apache = "Copyright 2020 X\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."
    texts = [(t, mark, end) for t in (mit, bsd, apache, gpl, mpl) for mark in ("", " * ", "# ", ";; ", "// ") for end in ("\n", "\r\n")]
    rows = [(i, end.join((mark + x).rstrip() for line in t.split("\n") for x in (textwrap.wrap(line, 72) or [""]))) for i, (t, mark, end) in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(50)] == [x for x in ("MIT", "BSD-2-Clause", "Apache-2.0", "GPL-2.0-or-later", "MPL-2.0") for _ in range(10)]
    assert {got[i].unmatched for i in range(50)} == {""} and {got[i].n_known for i in range(20, 30)} == {5}
    broken = [(0, "Released under\n\nthe MIT license"), (1, "Released under. The MIT license"), (2, "Not released under\nthe MIT license"), (3, "Released under\nthe MIT license, or not")]
    assert all(r.n_known == 0 for r in licenses.license_scan(spark.createDataFrame(broken, "doc_id long, text string")).collect())


def test_secrets(spark):
    rng = random.Random(6)
    token = "".join(rng.choices(secrets.ALPHABET[:62], k=40))
    text = f"é password = 'abcdefgh1' x AKIA{'A1' * 8} PASSWORD:short api-key {'0f' * 20} {token} internationalization_of_everything"
    rows = [(1, text), (2, None), (3, "the plain words of ordinary life and nothing_more_than_that_here")]
    got = {r.doc_id: r.spans for r in secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in got[1]] == [("assign", "password = 'abcdefgh1"), ("access", "AKIA" + "A1" * 8), ("hex", "0f" * 20), ("random", token)]
    assert got[2] == [] and got[3] == []


def brute_removal(texts):
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_dedup_on_tables(spark, tables):
    rows = hard_rows()
    want = Counter((r[0], *x) for r, x in zip(rows, brute_removal([(r[1] or "").encode() for r in rows])))
    got = suffix_dedup.query(spark, tables).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("seed, bits", [(1, 64), (2, 64), (3, 5), (4, 1)])
def test_suffix_dedup_on_patchworks(spark, seed, bits, monkeypatch):
    """Texts put together from pieces whose lengths lie around the limit, over a small alphabet, in small ranges; with few bits most hashes collide."""
    monkeypatch.setattr(suffix_dedup, "RANGE", 256)
    rng = random.Random(seed)
    pieces = ["".join(rng.choices("ab cd", k=rng.choice([40, 150, 195, 199, 200, 201, 215, 260, 420]))) for _ in range(25)]
    texts = ["".join(rng.choice(pieces) if rng.random() < 0.7 else "".join(rng.choices("xyz", k=rng.randrange(1, 60))) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), bits=bits).collect()
    want = brute_removal([t.encode() for t in texts])
    assert len(got) == len(texts)
    for r in got:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) == (n, removed, spans, kept), r.doc_id


def test_merge_never_compares_known_prefixes():
    rng = random.Random(3)
    for k in (1, 2, 3, 5, 9):
        runs = [sorted({bytes(rng.choices(b"a\0b", k=rng.choice([0, 3, 190]))) + b"a" * rng.choice([0, 100]) for _ in range(rng.randrange(1, 200))}) for _ in range(k)]
        coded = [tuple(x.tolist() if isinstance(x, np.ndarray) else x for x in suffix_dedup.front_code(x)) for x in runs]
        merged = [(runs[r][i], s) for r, i, s, x in suffix_dedup.merge_runs(coded) if x == runs[r][i]]
        assert [m[0] for m in merged] == sorted(x for run in runs for x in run)
        for (a, _), (b, s) in zip(merged, merged[1:]):
            assert s == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_pipeline_stages(spark, tables):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, tables)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
    assert docs.count() == corpus_pipeline.run(spark, tables).count()


def test_exponential_keys_follow_weights():
    """The sampling key -ln(u) / w: the chance to come first is proportional to w."""
    rng = random.Random(1)
    first = sum(-math.log(rng.random()) / 3 < -math.log(rng.random()) / 1 for _ in range(20000))
    assert abs(first / 20000 - 0.75) < 0.02


def test_secrets_inside_ordinary_runs():
    model, rng = secrets.RandomStrings(*secrets.labelled_samples([])), random.Random(4)
    for before in ("internal/configuration/service/environment/message/", "configuration.internal.session.value=", "internal/" * 40):
        tokens = ["".join(rng.choices(secrets.ALPHABET[:62], k=24)) for _ in range(200)]
        hit = sum(any(a <= len(before) and b >= len(before) + 24 for a, b, _ in model.spans(f"see {before}{t}/description"[4:])) for t in tokens)
        assert hit >= 190, (before, hit)
        assert not model.spans(before + "description")
    token = "".join(rng.choices(secrets.ALPHABET[:62], k=40))
    text = "AKIA" + "A" * 16 + "/" + token
    assert [x[:2] for x in model.spans(text, secrets.base_spans(text))] == [(20, 61)]


def test_spans_apart_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        made = [[(int(a), int(a + n), "x") for a, n in zip(rng.integers(0, 60, k), rng.integers(1, 12, k))] for k in rng.integers(0, 8, 2)]
        want = [s for s in made[0] if not any(o[0] < s[1] and s[0] < o[1] for o in made[1])]
        assert secrets.apart(made[0], made[1]) == want


def test_hot_keys_are_dealt_without_a_join(spark):
    """Rows of a key with many rows are dealt over parts by a list of hashes: the same rows as a plain join, and no outer join over all rows."""
    rows = spark.range(6000).select((F.col("id") % 2 * F.col("id")).alias("piece"), F.col("id").alias("h"))
    keys = rows.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    out = suffix_dedup._spread(rows, keys, ["piece"], ["h"], "inner")
    assert sorted((r.piece, r.h, r.n) for r in out.collect()) == sorted((i % 2 * i, i, 1 if i % 2 else 3000) for i in range(6000))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "_salt" in plan
