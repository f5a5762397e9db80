"""Densest sets, contraction by query-biased density and joining trees against enumeration and plain versions."""

import itertools
import random

import pytest

from graphloom.operators import densest as D
from graphloom.operators.search import biased


def best_sets(links, weight):
    """All vertices of sets of the largest density."""
    best, members = 0.0, set()
    for r in range(1, len(weight) + 1):
        for chosen in map(set, itertools.combinations(sorted(weight), r)):
            value = sum(w for u, v, w in links if u in chosen and v in chosen) / sum(weight[x] for x in chosen)
            if value > best * (1 + 1e-9):
                best, members = value, chosen
            elif best and value > best * (1 - 1e-9):
                members = members | chosen
    return members


def some_groups(n_groups):
    for g in range(n_groups):
        rng = random.Random(g)
        n, p = rng.randrange(2, 10), rng.choice([0.2, 0.4, 0.7])
        weight = {i: 1.0 if g % 2 else float(rng.choice([0.5, 1, 2, 5, 1e8])) for i in range(n)}
        yield g, [(a, b, float(rng.choice([1, 1, 3]) if g % 3 == 0 else 1)) for a in range(n) for b in range(a + 1, n) if rng.random() < p], weight


def frames(spark, groups):
    links = spark.createDataFrame([(g, *x) for g, ls, _ in groups for x in ls], "g long, u long, v long, w double")
    return links, spark.createDataFrame([(g, i, w) for g, _, ws in groups for i, w in ws.items()], "g long, node long, weight double")


def sets(rows):
    out = {}
    for g, node in rows:
        out.setdefault(g, set()).add(node)
    return out


@pytest.mark.parametrize("small,n", [(1000, 12), (0, 4)])
def test_densest_equals_enumeration(spark, small, n):
    """By one task for each group, and by joint pushes for all."""
    groups = list(some_groups(n))
    got = sets((r.g, r.node) for r in D.densest(*frames(spark, groups), small).collect())
    assert got == {g: best_sets(ls, ws) for g, ls, ws in groups if ls}


def test_densest_without_links(spark):
    links, nodes = frames(spark, [(1, [], {0: 1.0, 1: 2.0})])
    assert D.densest(links, nodes).collect() == []
    assert D.densest(links, nodes.limit(0)).collect() == []


def test_peeling_bound_and_trim(spark):
    groups = [x for x in some_groups(8) if x[1]]
    links, nodes = frames(spark, groups)
    bound = {r.g: r.rho for r in D.peeled(links, nodes).collect()}
    rho = spark.createDataFrame(list(bound.items()), "g long, rho double")
    kept = sets((r.g, r.node) for r in D.trimmed(links, nodes, rho)[1].collect())
    for g, ls, ws in groups:
        top = best_sets(ls, ws)
        value = sum(w for u, v, w in ls if u in top and v in top) / sum(ws[x] for x in top)
        assert value / 3 - 1e-9 <= bound[g] <= value + 1e-9 and top <= kept[g]


EDGES = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (5, 6), (4, 6), (3, 6), (6, 7), (7, 8), (9, 10)]


def proximities(edges, query, c=0.85, rounds=10):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    rank = {q: 1.0 for q in query}
    for _ in range(rounds):
        got = {v: c * sum(rank.get(w, 0) for w in ns) / len(ns) for v, ns in near.items() if any(w in rank for w in ns)}
        rank = {**got, **{q: 1.0 for q in query}}
    return rank


def plain_contracted(edges, query):
    weight = {v: 1 / max(x, 1e-8) for v, x in proximities(edges, query).items()}
    merged = set(query)
    while True:
        links, name = {}, lambda v: -1 if v in merged else v
        for a, b in edges:
            if a in weight and b in weight and name(a) != name(b):
                key = tuple(sorted((name(a), name(b))))
                links[key] = links.get(key, 0) + 1
        each = {-1: sum(weight.get(v, 0) for v in merged), **{v: w for v, w in weight.items() if v not in merged}}
        top = best_sets([(*k, w) for k, w in links.items()], each)
        merged = merged | (top - {-1})
        if -1 in top or not top - {-1}:
            return merged


@pytest.fixture(scope="module")
def asked():
    return {0: [0], 1: [7], 2: [1, 8], 3: [9], 4: [2, 6]}


def test_contraction_equals_plain(spark, asked):
    edges = spark.createDataFrame(EDGES, "u long, v long")
    queries = spark.createDataFrame([(q, v) for q, vs in asked.items() for v in vs], "query_id long, node long")
    got = sets(tuple(r) for r in biased.contracted_density(edges, queries).select("query_id", "node").collect())
    assert got == {q: plain_contracted(EDGES, vs) for q, vs in asked.items()}
    two = sets(tuple(r) for r in biased.densest_biased(edges, queries).select("query_id", "node").collect())
    for q, vs in asked.items():
        weight = {v: 1 / x for v, x in proximities(EDGES, vs).items()}
        assert two[q] == best_sets([(a, b, 1.0) for a, b in EDGES if a in weight and b in weight], weight) | set(vs)
    whole = sets(tuple(r) for r in biased.best_biased(edges, queries, k=3).select("query_id", "node").collect())
    assert all(set(vs) <= whole[q] and (connected(EDGES, whole[q]) or q == 3) for q, vs in asked.items())


def connected(edges, members):
    seen, todo = {min(members)}, [min(members)]
    while todo:
        v = todo.pop()
        new = {b if a == v else a for a, b in edges if v in (a, b)} & members - seen
        seen |= new
        todo += new
    return seen == members


def smallest_tree(edges, terminals):
    others = sorted({x for e in edges for x in e} - set(terminals))
    for r in range(len(others) + 1):
        for extra in itertools.combinations(others, r):
            if connected(edges, set(terminals) | set(extra)):
                return len(terminals) + r - 1
    return None


def test_trees_join_queries(spark):
    rng = random.Random(6)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(24)) if a != b} | {(i, i + 1) for i in range(12)} | {(20, 21)})
    asked = {q: sorted(rng.sample(range(13), n)) for q, n in enumerate((1, 2, 3, 4, 5))} | {9: [0, 20]}
    queries = spark.createDataFrame([(q, v) for q, vs in asked.items() for v in vs], "query_id long, node long")
    got = sets(tuple(r) for r in biased.joined(spark.createDataFrame(edges, "u long, v long"), queries).collect())
    assert got.pop(9) == {0, 20} and got[0] == set(asked[0])
    for q, members in got.items():
        assert set(asked[q]) <= members and connected(edges, members) and len(members) - 1 <= 2 * smallest_tree(edges, asked[q])
    assert len(got[1]) - 1 == smallest_tree(edges, asked[1])


@pytest.mark.parametrize("n,p", [(12, 0.9), (12, 0.1), (40, 0.2), (5, 1.0)])
def test_edge_deltas_of_any_density(spark, n, p):
    """As many pairs to add as edges to delete, none of them an edge, nested by percentage; a nearly full graph gives what it has."""
    from graphloom.operators import prep

    rng = random.Random(n)
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p} | {(0, 1)}
    found = {}
    for r in prep.edge_deltas(spark.createDataFrame(sorted(edges), "u long, v long")).collect():
        found.setdefault((r.op, r.pct), set()).add((r.u, r.v))
    nodes = {x for e in edges for x in e}
    for pct in (10, 20, 30):
        want = len(edges) * pct // 100
        added = found.get(("add", pct), set())
        assert len(found.get(("del", pct), set())) == want and found.get(("del", pct), set()) <= edges
        assert len(added) == min(want, len(nodes) * (len(nodes) - 1) // 2 - len(edges)) and not added & edges and all(a < b for a, b in added)
        assert added <= found.get(("add", 30), set())


def test_balanced_shares_meet_the_density(spark):
    """A clique with a tail: no load is above the density of the clique, which is among the sets looked at."""
    links = [(0, a, b, 1.0) for a in range(6) for b in range(a + 1, 6)] + [(0, i, i + 1, 1.0) for i in range(5, 9)]
    nodes = spark.createDataFrame([(0, i, 1.0) for i in range(10)], "g long, node long, weight double")
    shares, best = D.balanced(spark.createDataFrame(links, "g long, u long, v long, w double"), nodes)
    load = [0.0] * 10
    for r in shares.collect():
        assert 0 <= r.x <= r.w
        load[r.u] += r.x
        load[r.v] += r.w - r.x
    assert best.first().rho == pytest.approx(2.5) and max(load) <= 2.5 * (1 + 1e-8) and sum(load) == pytest.approx(len(links))


def test_large_groups_are_settled_by_connected_parts(spark, monkeypatch):
    """Two equally dense parts and a looser one: each is small enough for one task, so nothing flows by joins, and both dense ones are the answer."""
    from itertools import combinations

    from graphloom.operators import densest as operators

    monkeypatch.setattr(operators, "overfull", lambda *_: pytest.fail("flows by joins"))
    links = [(g, u + s, v + s, 1.0) for g in (0, 1) for s in (0, 10) for u, v in combinations(range(5), 2)] + [(0, 20, 21, 1.0), (0, 21, 22, 1.0), (1, 4, 5, 1.0)]
    nodes = sorted({(g, x, 1.0) for g, u, v, _ in links for x in (u, v)})
    found = operators.densest(spark.createDataFrame(links, "g long, u long, v long, w double"), spark.createDataFrame(nodes, "g long, node long, weight double"), small=12)
    assert {(r.g, r.node) for r in found.collect()} == {(g, s + i) for g in (0, 1) for s in (0, 10) for i in range(5)}
