"""Operators against versions written plainly, and readers, writers, indexes and principal components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import index, prep, recommend, structure
from graphloom.operators.search import scored, search
from graphloom.sources import text


@pytest.fixture(scope="module")
def net(spark):
    rng = np.random.default_rng(11)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 40, (90, 2)).tolist() if a != b})
    return pairs


def test_spanning_forest_is_kruskals(spark, net):
    pairs = net
    weighted = [(a, b, (a * 7 + b * 3) % 5) for a, b in pairs]
    root = {v: v for e in pairs for v in e}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    want = set()
    for a, b, w in sorted(weighted, key=lambda e: (-e[2], e[0], e[1])):
        if top(a) != top(b):
            root[top(a)] = top(b)
            want.add((a, b, w))
    assert {tuple(r) for r in structure.spanning_forest(spark.createDataFrame(weighted, "u long, v long, w long")).collect()} == want


def test_matrix_features_and_components(spark, tmp_path):
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 10))
    np.save(tmp_path / "feat_attr.npy", matrix.astype(np.float32))
    rows = text.read_matrix(spark, str(tmp_path / "feat_attr.npy"))
    assert rows.count() == 300
    long = rows.select(F.col("id").alias("node"), F.posexplode("feat").alias("j", "x"))
    out = recommend.reduced(long, 3).groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    assert sorted(r.j for r in out) == [0, 1, 2] and all(abs(r.m) < 1e-6 and abs(r.s - 1) < 1e-6 for r in out)
    first = np.array([r.x for r in recommend.reduced(long, 3).filter("j = 0").orderBy("node").collect()])
    want = (matrix - matrix.mean(0)) @ np.linalg.svd(matrix - matrix.mean(0))[2][0]
    assert abs(np.corrcoef(first, want)[0, 1]) > 0.999


def test_members_are_appended_and_indexes_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(0, 3), (0, 1), (1, 2)], "community_id long, node long")
    for _ in range(2):
        text.append_members(rows, str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["1 3", "1 3", "2", "2"]
    index.save({"a": rows}, str(tmp_path / "index"))
    index.save({"a": rows.limit(1)}, str(tmp_path / "index"))
    assert index.load(spark, str(tmp_path / "index"), "a").count() == 1
    assert [r.k for r in spark.createDataFrame([("1.0", "1"), ("0.3000001", "0.3"), ("2_3", "2.0_3")], "a string, b string").filter(recommend.parameter_key(F.col("a")) == recommend.parameter_key(F.col("b"))).select(F.lit(1).alias("k")).collect()] == [1, 1, 1]


def _reached(pairs, start, gone=None):
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if x == v and y != gone and y not in seen:
                    seen.add(y)
                    todo.append(y)
    return seen


def test_blocks_and_cut_vertices(spark):
    rng = np.random.default_rng(5)
    for n, m in ((40, 46), (30, 60)):
        pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (m, 2)).tolist() if a != b})
        nodes = {v for e in pairs for v in e}
        near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in nodes}
        want = {v for v in nodes if not near[v] <= _reached(pairs, min(near[v]), v)}
        edges = spark.createDataFrame([*pairs, (3, 3), pairs[0][::-1]], "u long, v long")
        got = structure.biconnected(edges).collect()
        assert sorted((r.u, r.v) for r in got) == pairs
        assert {r.node for r in structure.articulation_points(edges).collect()} == want and want
        size = {}
        for r in got:
            size[r.block] = size.get(r.block, 0) + 1
        bridges = {(a, b) for a, b in pairs if b not in _reached([e for e in pairs if e != (a, b)], a)}
        assert {(r.u, r.v) for r in got if size[r.block] == 1} == bridges
    assert structure.articulation_points(edges.limit(0)).count() == 0


def test_nibble_finds_a_planted_clique(spark):
    """Against the level's pushes, marks and sweep written plainly over the whole graph."""
    blocks = [list(range(i * 8, i * 8 + 8)) for i in range(6)]
    pairs = [(a, b) for block in blocks for a in block for b in block if a < b] + [(i * 8, i * 8 + 8) for i in range(5)]
    near = {v: sorted({b if a == v else a for a, b in pairs if v in (a, b)}) for v in range(48)}
    m, phi = len(pairs), 0.3
    top = int(np.ceil(np.log2(m)))

    def plain(q):
        for level in range(1, top + 1):
            eps, p, r, todo = 1 / (2**level * 48 * top), {}, {q: 1.0}, [q]
            while todo:
                v = todo.pop(0)
                if r[v] < eps * len(near[v]):
                    continue
                mass = r[v]
                p[v], r[v] = p.get(v, 0) + 0.01 * mass, 0.99 * mass / 2
                for w in near[v]:
                    before = r.get(w, 0.0)
                    r[w] = before + 0.99 * mass / 2 / len(near[v])
                    if before < eps * len(near[w]) <= r[w]:
                        todo.append(w)
                if r[v] >= eps * len(near[v]):
                    todo.append(v)
            order = sorted(p, key=lambda v: (-p[v] / len(near[v]), v))
            volumes, masses = np.cumsum([0] + [len(near[v]) for v in order]), np.cumsum([0] + [p[v] for v in order])
            for i in range(1, len(order) + 1):
                s, vol = set(order[:i]), volumes[i]
                cut = sum(w not in s for v in s for w in near[v])
                if vol < 2**level or vol <= 2 ** (level - 1) or vol >= 4 / 3 * m or q not in s or cut / min(vol, 2 * m - vol) >= phi:
                    continue
                if np.diff(np.interp([2 ** (level - 1), 2**level], volumes, masses))[0] > 1 / (48 * top):
                    return s
        return {q}

    queries = spark.createDataFrame([(q, q) for q in (3, 16, 45)], "query_id long, node long")
    got = {}
    for r in search("ppr", spark.createDataFrame(pairs, "u long, v long"), queries).collect():
        got.setdefault(r.query_id, set()).add(r.node)
    assert got == {q: plain(q) for q in (3, 16, 45)} and all(len(s) >= 6 for s in got.values())  # six of a clique of eight already have a conductance below 0.3


def _near(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def _part(near, start, inside):
    seen, todo = {start}, [start]
    while todo:
        for w in near.get(todo.pop(), set()) & inside - seen:
            seen.add(w)
            todo.append(w)
    return seen


def _sets(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], set()).add(r["node"])
    return out


def test_searches_by_scores(spark, net):
    """Prefixes, heap and swap growth written plainly over the whole graph; scores tie, and a query may have several vertices."""
    near = _near(net)
    nodes = sorted(near)
    asked = {0: [nodes[0]], 1: [nodes[5], nodes[9]], 2: [nodes[-1]]}
    score = {(q, v): (v * 37 + q * 11) % 23 / 23 for q in asked for v in nodes}
    edges = spark.createDataFrame(net, "u long, v long").cache()
    queries = spark.createDataFrame([(q, v) for q, vs in asked.items() for v in vs], "query_id long, node long").cache()
    scores = spark.createDataFrame([(q, v, s) for (q, v), s in score.items()], "query_id long, node long, score double").cache()

    def prefix(q):
        order = sorted(nodes, key=lambda v: (-score[q, v], v))
        sums, mean = np.cumsum([score[q, v] for v in order]), np.mean([score[q, v] for v in order])
        size = np.arange(1, len(order) // 2 + 1)
        best = int(np.argmax(np.round((sums[: len(size)] - size * mean) / np.sqrt(size), 12))) + 1
        inside = set(order[:best]) | set(asked[q])
        found = _part(near, asked[q][0], inside)
        return found if set(asked[q]) <= found else set(asked[q])

    def heap(q, top=12):
        c = set(asked[q])
        while len(c) < top:
            shell = {w for v in c for w in near[v]} - c
            if not shell:
                break
            c.add(min(shell, key=lambda w: (-score[q, w], w)))
        return c

    assert _sets(scored.prefix_component(edges, queries, scores).collect(), "query_id") == {q: prefix(q) for q in asked}
    assert _sets(scored.heap_growth(edges, queries, scores, top=12).collect(), "query_id") == {q: heap(q) for q in asked}
    swapped = _sets(scored.swap_growth(edges, queries, scores, top=9).collect(), "query_id")
    for q, c in swapped.items():
        start = list(asked[q])
        for v in start:  # the breadth order that it starts from
            start += [w for w in sorted(near[v]) if w not in start]
        assert set(asked[q]) <= c and len(c) == len(start[:9])
        assert sum(score[q, v] for v in c) >= sum(score[q, v] for v in start[:9]) - 1e-9
        if len(asked[q]) == 1:
            assert _part(near, asked[q][0], c) == c
            for v in c - set(asked[q]):  # no swap is left that would raise the sum
                for w in {w for x in c for w in near[x]} - c:
                    after = c - {v} | {w}
                    assert score[q, w] <= score[q, v] or _part(near, asked[q][0], after) != after


def test_features_of_ego_nets(spark, net):
    near = _near(net)
    edges = spark.createDataFrame(net, "u long, v long").cache()
    start = sorted(near)[3]
    dist, todo = {start: 0}, [start]
    for v in todo:
        for w in sorted(near[v] - dist.keys()):
            dist[w] = dist[v] + 1
            todo.append(w)
    core, left, k = {}, {v: set(ws) for v, ws in near.items()}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for w in left.pop(v):
            left[w].discard(v)
    got = recommend.ego_features(edges, spark.createDataFrame([(7, start)], "query_id long, node long"), size=12, rounds=10).collect()
    want = sorted(dist, key=lambda v: (dist[v], v))[:12]
    assert {r.node: (r.core, r.is_query, r.dist) for r in got} == {v: (core[v], int(v == start), dist[v]) for v in want}
    z = np.array([r.log_ppr_z for r in got])
    assert abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 0.1 and max(got, key=lambda r: r.log_ppr_z).node == start


def test_samples_and_repair(spark, net):
    near = _near(net)
    nodes = sorted(near)
    edges = spark.createDataFrame(net, "u long, v long").cache()
    member = {f"c{i}": set(nodes[i::4]) | set(nodes[4 * i : 4 * i + 5]) for i in range(4)}
    sets = spark.createDataFrame([(c, v) for c, vs in member.items() for v in vs], "community string, node long").cache()

    want = {}
    for c, vs in member.items():
        first = min(vs)
        dist, todo = {first: 0}, [first]
        for v in todo:
            for w in near[v] & vs - dist.keys():
                dist[w] = dist[v] + 1
                todo.append(w)
        order = sorted(dist, key=lambda v: (dist[v], v))
        for i, v in enumerate(order):
            want[c, i] = (v, len({w for x in order[:i] for w in near[x] & vs} - set(order[:i])))
    assert {(r.community, r.step): (r.node, r.frontier) for r in prep.rollout_samples(edges, sets).collect()} == want

    sides = {r.community: r.side for r in prep.split_communities(sets).collect()}
    drawn = prep.inductive_samples(sets, (("train", 6), ("valid", 4), ("test", 5))).collect()
    for split, n in (("train", 6), ("valid", 4), ("test", 5)):
        rows = [r for r in drawn if r.split == split]
        assert len({r.query_id for r in rows}) == len(rows) == n
        assert all(r.node in member[r.community] and (sides[r.community] == "test") == (split == "test") for r in rows)

    vertices = spark.createDataFrame([(v,) for v in nodes], "node long")
    asked = [prep.random_queries(vertices, 40).collect() for _ in range(2)]
    assert sorted(map(tuple, asked[0])) == sorted(map(tuple, asked[1]))
    found = _sets(asked[0], "query_id")
    assert set(found) == set(range(40)) and {len(s) for s in found.values()} == {1, 2, 3} and all(s <= set(nodes) for s in found.values())

    fixed = prep.repaired(edges, sets).collect()
    assert fixed
    assert len({r.node for r in fixed}) == len(fixed)
    for c in _sets(fixed, "community_id").values():
        assert len(c) >= 3 and _part(near, min(c), c) == c and any(c <= vs for vs in member.values())


def test_rollout_of_a_star_has_no_row_for_each_wait(spark):
    """All leaves border on the first member: each step finds one fewer, without rows for all steps that a leaf waits."""
    n = 300
    edges = spark.createDataFrame([(0, i) for i in range(1, n)], "u long, v long")
    out = prep.rollout_samples(edges, spark.createDataFrame([("a", i) for i in range(n)], "community string, node long"))
    assert {r.step: (r.node, r.frontier) for r in out.collect()} == {i: (i, n - i if i else 0) for i in range(n)}
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
