"""Fixpoints by blocks against plain versions, with blocks so small that they must shift and agree."""

import random

import pytest

from graphloom.operators import structure
from graphloom.operators.search import structural


def drawn(seed, n, m):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | {(i, i + 1) for i in range(n, n + 30)})


def near(edges):
    out = {}
    for u, v in edges:
        out.setdefault(u, set()).add(v)
        out.setdefault(v, set()).add(u)
    return out


def plain_cores(edges):
    adj, core, k = near(edges), {}, 0
    degree = {v: len(a) for v, a in adj.items()}
    while degree:
        v = min(degree, key=lambda x: (degree[x], x))
        k = core[v] = max(k, degree.pop(v))
        for w in adj[v] & degree.keys():
            degree[w] -= 1
    return core


@pytest.mark.parametrize("seed, n, m, half", [(1, 200, 800, 300), (2, 60, 500, 10**6)])
def test_core_numbers_by_blocks(spark, seed, n, m, half):
    edges = drawn(seed, n, m)
    found = structure.core_numbers(spark.createDataFrame(edges, "u long, v long"), half=half)
    assert {r.node: r.core for r in found.collect()} == plain_cores(edges)


@pytest.mark.parametrize("small", [10**6, 40])
@pytest.mark.parametrize("use_max", [False, True])
def test_kcore_by_a_forest(spark, small, use_max):
    """One task for all levels, and levels by joins over a forest of many ranges."""
    edges = drawn(3, 80, 160)
    core, adj = plain_cores(edges), near(edges)
    asked = [(q, v) for q, vs in enumerate(([0, 1], [2], [85], [5, 85], [7, 30], [min(core, key=core.get)])) for v in vs if v in core]
    want = set()
    for q in {q for q, _ in asked}:
        vs = [v for i, v in asked if i == q]
        k = (max if use_max else min)(core[v] for v in vs)
        seen, parts = set(), []
        for v in sorted(v for v in vs if core[v] >= k):
            if v not in seen:
                part, todo = {v}, [v]
                while todo:
                    for w in adj[todo.pop()]:
                        if core[w] >= k and w not in part:
                            part.add(w)
                            todo.append(w)
                seen |= part
                parts.append(part)
        parts = sorted((p for p in parts if use_max or set(vs) <= p), key=min)
        want |= {(q, v) for v in (parts[0] if parts else ())}
    found = structural.kcore(spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame(asked, "query_id long, node long"), use_max=use_max, small=small)
    assert {tuple(r) for r in found.collect()} == want


@pytest.mark.parametrize("half", [150, 10**6])
def test_truss_numbers_by_blocks(spark, half):
    edges = drawn(4, 45, 330)
    adj, want, left, k = near(edges), {}, set(edges), 2
    while left:
        weak = [(u, v) for u, v in left if sum(tuple(sorted((u, w))) in left and tuple(sorted((v, w))) in left for w in adj[u] & adj[v]) < k - 1]
        want |= dict.fromkeys(weak, k)
        left -= set(weak)
        k += not weak
    found = structure.truss_numbers(spark.createDataFrame(edges, "u long, v long"), half=half)
    assert {(r.u, r.v): r.truss for r in found.collect()} == want
