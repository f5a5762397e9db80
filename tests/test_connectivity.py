"""Edge connectivity against cuts found by flows, on graphs of several kinds; with small tasks allowed everything is contracted and cut by joins."""

import random

import pytest

from graphloom.operators import index
from graphloom.operators.connectivity import _parts, beyond_forests, edge_connectivity
from graphloom.operators.search import structural
from graphloom.operators.structure import spanning_forest


def reached(nodes, edges, start):
    near = {v: set() for v in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, todo = {start}, [start]
    while todo:
        new = near[todo.pop()] - seen
        seen |= new
        todo += new
    return seen


def small_side(nodes, edges, k):
    """One side of a cut of fewer than k edges, by augmenting paths from one vertex to each other."""
    s, *others = sorted(nodes)
    for t in others:
        room = {}
        for a, b in edges:
            room.setdefault(a, {})[b] = room.setdefault(b, {})[a] = 1
        for _ in range(k):
            parent, queue = {s: None}, [s]
            for v in queue:
                for w, c in room.get(v, {}).items():
                    if c > 0 and w not in parent:
                        parent[w] = v
                        queue.append(w)
            if t not in parent:
                return set(parent)
            v = t
            while parent[v] is not None:
                room[parent[v]][v] -= 1
                room[v][parent[v]] += 1
                v = parent[v]
    return None


def plain_connectivity(edges):
    level, k, parts = dict.fromkeys(edges, 0), 1, [{x for e in edges for x in e}]
    while parts:
        done, todo = [], parts
        while todo:
            part = todo.pop()
            inner = [e for e in edges if e[0] in part and e[1] in part]
            if len(part) < 2:
                continue
            side = reached(part, inner, min(part))
            if side == part:
                side = small_side(part, inner, k)
            if side is None:
                done.append(part)
                level.update(dict.fromkeys(inner, k))
            else:
                todo += [side, part - side]
        parts, k = done, k + 1
    return level


def sorted_pairs(pairs):
    return sorted({(min(p), max(p)) for p in pairs})


def graphs():
    rng = random.Random(1)
    some = [(a, b) for a in range(14) for b in range(a) if rng.random() < 0.3]
    cliques = [(a + s, b + s) for s in (0, 10, 20) for a in range(6) for b in range(a)] + [(0, 10), (1, 11), (10, 20), (2, 3)]
    cubic = [(i, (i + 1) % 8) for i in range(8)] + [(i, i + 4) for i in range(4)] + [(0, 50), (50, 51)]
    return {"random": sorted_pairs(some), "cliques": sorted_pairs(cliques), "cubic": sorted_pairs(cubic), "tree": sorted_pairs([(i, i // 2) for i in range(1, 9)])}


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long")


@pytest.mark.parametrize("name,leftover", [("random", 1000), ("cliques", 20), ("cubic", 1000), ("tree", 2)])
def test_connectivity_equals_flows(spark, name, leftover):
    edges = graphs()[name]
    assert {(r.u, r.v): r.w for r in edge_connectivity(frame(spark, edges), leftover).collect()} == plain_connectivity(edges)


def test_no_edges_and_repeats(spark):
    assert edge_connectivity(frame(spark, [])).collect() == []
    assert [tuple(r) for r in edge_connectivity(frame(spark, [(1, 2), (2, 1), (1, 2), (3, 3)])).collect()] == [(1, 2, 1)]


def test_parts_of_many_random_graphs():
    for seed in range(60):
        rng = random.Random(seed)
        edges = sorted_pairs((a, b) for a in range(12) for b in range(a) if rng.random() < rng.choice((0.2, 0.4)))
        want = plain_connectivity(edges)
        near = {}
        for a, b in edges:
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1
        for k in (2, 3, 4):
            part = {x: i for i, p in enumerate(_parts(near, k)) for x in p}
            assert {e for e in edges if part[e[0]] == part[e[1]]} == {e for e in edges if want[e] >= k}


def test_index_answers_as_the_search_does(spark, tmp_path):
    edges = frame(spark, graphs()["cliques"])
    asked = spark.createDataFrame([(0, 0), (1, 12), (2, 1), (2, 13), (3, 99)], "query_id long, node long")
    index.save(index.connectivity_index(edges), str(tmp_path))
    for name in ("edges", "forest"):
        got = structural.kecc(edges, asked, index.load(spark, str(tmp_path), name))
        assert sorted(map(tuple, got.collect())) == sorted([(0, x) for x in range(6)] + [(1, x) for x in range(10, 16)] + [(2, x) for x in (*range(6), *range(10, 16))])


def test_forests_of_groups(spark):
    rows = [(1, 0, 1, 3), (1, 1, 2, 2), (1, 0, 2, 1), (2, 0, 1, 1), (2, 1, 2, 2), (2, 0, 2, 3), (2, 7, 8, 5)]
    got = spanning_forest(spark.createDataFrame(rows, "k int, u long, v long, w long"), by=["k"]).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, 3), (1, 1, 2, 2), (2, 0, 2, 3), (2, 1, 2, 2), (2, 7, 8, 5)]


def test_what_forests_leave_is_connected(spark):
    """Beyond k - 1 forests only edges with k edge-disjoint paths are left, and at most (k - 1)(n - 1) are taken."""
    edges = graphs()["cliques"]
    rows = [(3, a, b, 1) for a, b in edges]
    left = [(r.u, r.v) for r in beyond_forests(spark.createDataFrame(rows, "k int, a long, b long, w long")).collect()]
    assert len(left) >= len(edges) - 2 * (len({x for e in edges for x in e}) - 1)
    for a, b in left:
        room = set(edges) | {(x, y) for y, x in edges}
        for _ in range(3):
            parent, queue = {a: None}, [a]
            for v in queue:
                queue += [w for x, w in room if x == v and w not in parent and not parent.update({w: v})]
            assert b in parent
            v = b
            while parent[v] is not None:
                room.remove((parent[v], v))
                room.add((v, parent[v]))
                v = parent[v]
