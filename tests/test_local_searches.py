"""Searches that grow or peel from a query against the same rules written plainly over whole random graphs, with few and with many candidates at first."""

import itertools
import random
from functools import partial

import pytest

from graphloom.operators.search import biased, local, peeling, scored


def near_of(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def part(near, start, inside):
    seen, todo = {start}, [start]
    while todo:
        for w in near[todo.pop()] & inside - seen:
            seen.add(w)
            todo.append(w)
    return seen


def random_pairs(seed, n, m):
    rng = random.Random(seed)
    return sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def sets(rows):
    out = {}
    for q, node in rows:
        out.setdefault(q, set()).add(node)
    return out


GRAPHS = [[(i, i + 1) for i in range(7)] + [(0, 2), (4, 6), (20, 21)], random_pairs(1, 26, 48)]


@pytest.fixture(scope="module", params=range(len(GRAPHS)))
def case(spark, request):
    pairs = GRAPHS[request.param]
    nodes = sorted(near_of(pairs))
    asked = {0: [nodes[0]], 1: [nodes[3]], 2: [nodes[-1]], 3: [nodes[1], nodes[5]]}
    edges = spark.createDataFrame(pairs, "u long, v long").cache()
    queries = spark.createDataFrame([(q, v) for q, vs in asked.items() for v in vs], "query_id long, node long").cache()
    return pairs, near_of(pairs), asked, edges, queries


def plain_lm(near, query, k):
    c = set(query)

    def ratio(c):
        border = {v for v in c if near[v] - c}
        touching = sum(1 for a in c for b in near[a] if a < b and (a in border or b in border) and b in c)
        leaving = sum(len(near[v] - c) for v in c)
        return touching / (touching + leaving) if touching + leaving else 0.0

    while len(c) < k:
        shell = {w for v in c for w in near[v]} - c
        if not shell:
            break
        c.add(min(shell, key=lambda w: (-ratio(c | {w}), w)))
    return c


def plain_sgm(near, query, pinned):
    def value(c):
        inside, leaving = sum(len(near[v] & c) for v in c) / 2, sum(len(near[v] - c) for v in c)
        return inside / leaving if leaving else float("inf")

    c, order = set(query), lambda vs: sorted(vs, key=lambda v: (-len(near[v]), -v))
    while True:
        before = set(c)
        for w in order({w for v in c for w in near[v]} - c):
            if value(c | {w}) > value(c):
                c = c | {w}
        for v in order(c - set(query) if pinned else c):
            rest = c - {v}
            if rest and part(near, min(rest), rest) == rest and value(rest) > value(c):
                c = rest
        if c == before or value(c) == float("inf"):
            return c


def plain_dmcs(pairs, near, query):
    m = len(pairs)

    def worth(c):
        e, vol = sum(len(near[v] & c) for v in c) / 2, sum(len(near[v]) for v in c)
        return e / len(c) - vol * vol / (4 * m * len(c))

    dist = {v: 0 for v in query}
    todo = list(query)
    for v in todo:
        for w in sorted(near[v] - dist.keys()):
            dist[w] = dist[v] + 1
            todo.append(w)
    whole = max(range(max(dist.values()) + 1), key=lambda d: (worth({v for v in dist if dist[v] <= d}), -d))
    c = {v for v in dist if dist[v] <= whole}
    best = set(c)
    for d in range(whole, 0, -1):
        layer = {v for v in c if dist[v] == d}
        while layer:
            v = min(layer, key=lambda x: (-len(near[x]) / max(1, len(near[x] & c)), x))
            layer.remove(v)
            c = c - {v}
            if worth(c) > worth(best) + 1e-12:
                best = set(c)
    return best | set(query)


def weights_of(near, query, c=0.85, rounds=10):
    rank = {q: 1.0 for q in query}
    for _ in range(rounds):
        got = {v: c * sum(rank.get(w, 0) for w in ns) / len(ns) for v, ns in near.items() if any(w in rank for w in ns)}
        rank = {**got, **{q: 1.0 for q in query}}
    return {v: 1 / max(x, 1e-8) for v, x in rank.items()}


def plain_qdc(near, query, k):
    weight = weights_of(near, query)
    of = lambda v: weight.get(v, 1e8)
    c = set(query)
    value = lambda c: sum(len(near[v] & c) for v in c) / 2 / sum(map(of, c))
    best = set(c)
    while len(c) <= k:
        shell = {w for v in c for w in near[v]} - c
        if not shell:
            break
        c = c | {min(shell, key=lambda w: (-round(len(near[w] & c) / of(w), 12), w))}
        if value(c) > value(best) + 1e-12:
            best = set(c)
    return best


@pytest.mark.parametrize("size", [3, 500])
def test_growth_equals_plain(case, size):
    pairs, near, asked, edges, queries = case
    got = sets(tuple(r) for r in local.local_modularity(edges, queries, 6, size).collect())
    assert got == {q: plain_lm(near, vs, 6) for q, vs in asked.items()}
    for pinned in (False, True):
        got = sets(tuple(r) for r in local.subgraph_modularity(edges, queries, size, pinned).collect())
        assert got == {q: plain_sgm(near, vs, pinned) for q, vs in asked.items()}
        assert not pinned or all(set(vs) <= got[q] for q, vs in asked.items())


def test_peeled_layers_and_biased_growth_equal_plain(case):
    pairs, near, asked, edges, queries = case
    single = {q: vs for q, vs in asked.items() if len(vs) == 1}
    one = queries.filter("query_id < 3")
    assert sets(tuple(r) for r in local.density_modularity(edges, one).collect()) == {q: plain_dmcs(pairs, near, vs) for q, vs in single.items()}
    assert sets(tuple(r) for r in local.query_biased_density(edges, one, k=8).collect()) == {q: plain_qdc(near, vs, 8) for q, vs in single.items()}


def test_heap_growth_by_mean_and_threshold(spark, case):
    """A heap that takes vertices by score as long as one reaches the mean of what joined before it."""
    pairs, near, asked, edges, queries = case
    score = {(q, v): (v * 37 + q * 11) % 23 / 23 for q in asked for v in near}
    scores = spark.createDataFrame([(q, v, s) for (q, v), s in score.items()], "query_id long, node long, score double")

    def plain(q, stays):
        order, heard = list(asked[q]), 0.0
        while True:
            shell = {w for v in order for w in near[v]} - set(order)
            best = min(shell, key=lambda w: (-score[q, w], w), default=None)
            if best is None or len(order) >= 3 and not stays(score[q, best], heard / len(order)):
                return set(order)
            order, heard = [*order, best], heard + score[q, best]

    for rule, stays in (({"mean": True}, lambda x, mean: x >= mean), ({"threshold": 0.6}, lambda x, mean: x >= 0.6)):
        got = sets(tuple(r) for r in scored.heap_growth(edges, queries, scores, size=4, **rule).collect())
        assert got == {q: plain(q, stays) for q in asked}


def plain_blocks(pairs, members):
    """Edges that the removal of no vertex parts."""
    edges = [e for e in pairs if set(e) <= members]
    near = near_of(edges)
    label = {x: {v: min(part(near, v, members - {x})) for v in members - {x} if v in near} for x in members}
    together = lambda e, f: all(len({label[x][v] for v in {*e, *f} - {x}}) == 1 for x in members)
    found = []
    for e in edges:
        mine = frozenset(v for f in edges if e == f or together(e, f) for v in f)
        if mine not in found:
            found.append(mine)
    return set(found)


def plain_peel(pairs, near, query, alpha, whole):
    weight = weights_of(near, query)
    left = part(near, query[0], set(near)) & weight.keys()
    if not set(query) <= left:
        return set(query)
    links = lambda c: sum(1 for a, b in pairs if a in c and b in c)
    value = lambda c: links(c) / sum(weight[v] for v in c)
    strength = lambda v: (round(len(near[v] & left) / weight[v], 12), v)
    best = set(left)
    while len(left) > len(query):
        goes = {min(b - set(query), key=strength) for b in whole(pairs, left) if not b <= set(query)}
        if not goes:
            break
        if len(goes) > 1 and all(strength(v)[0] > alpha * value(left) * (1 + 1e-9) for v in goes):
            goes = {min(goes, key=strength)}
        left = left - goes
        if value(left) > value(best) * (1 + 1e-9):
            best = set(left)
    return best | set(query)


def test_blocks_equal_plain():
    for seed, (n, m) in itertools.product(range(12), ((6, 8), (10, 13), (9, 20))):
        pairs = random_pairs(seed, n, m)
        near = near_of(pairs)
        members = set(list(near)[: n - seed % 3])
        near_full = {v: near.get(v, set()) for v in members | near.keys()}
        assert {frozenset(b) for b in peeling.blocks(near_full, members)} == plain_blocks(pairs, members)
    assert peeling.blocks({}, set()) == [] and peeling.blocks({1: set()}, {1}) == []


def test_block_peeling_equals_plain(case):
    pairs, near, asked, edges, queries = case
    alpha = 2.0 if len(pairs) < 20 else 0.5
    got = sets(tuple(r) for r in biased.block_peeled(edges, queries, alpha).collect())
    assert got == {q: plain_peel(pairs, near, vs, alpha, plain_blocks) for q, vs in asked.items()}


def test_large_queries_are_thinned_first(case):
    """With a bound of a few links: the query stays, and no answer is thinner than the whole."""
    pairs, near, asked, edges, queries = case
    got = sets(tuple(r) for r in biased.block_peeled(edges, queries, small=5).collect())
    assert got.keys() == asked.keys()
    for q, vs in asked.items():
        weight = weights_of(near, vs)
        value = lambda c: sum(1 for a, b in pairs if a in c and b in c) / sum(weight[v] for v in c)
        whole = part(near, vs[0], set(near)) & weight.keys()
        assert set(vs) <= got[q] and (got[q] == set(vs) if not set(vs) <= whole else value(got[q]) >= value(whole) * (1 - 1e-9))


def test_peeling_of_nothing(spark):
    none = spark.createDataFrame([], "u long, v long")
    asked = spark.createDataFrame([(1, 5), (2, 6), (2, 7)], "query_id long, node long")
    assert sets(tuple(r) for r in biased.block_peeled(none, asked).collect()) == {1: {5}, 2: {6, 7}}
    assert biased.block_peeled(none, asked.limit(0)).collect() == []


def test_auto_takes_the_denser_fallback(case):
    pairs, near, asked, edges, queries = case
    both = [sets(tuple(r) for r in f(edges, queries).select("query_id", "node").collect()) for f in (biased.block_peeled, partial(local.query_biased_density, k=8))]
    weights = biased.biased_weights(edges, queries)
    frames = [edges.sparkSession.createDataFrame([(q, v) for q, vs in got.items() for v in vs], "query_id long, node long") for got in both]
    found = sets(tuple(r) for r in biased._denser(edges, weights, *frames).collect())
    for q, vs in asked.items():
        weight = weights_of(near, vs)
        value = lambda c: round(sum(1 for a, b in pairs if a in c and b in c) / sum(weight.get(v, 1e8) for v in c), 12)
        assert found[q] == (both[0][q] if value(both[0][q]) >= value(both[1][q]) else both[1][q])
