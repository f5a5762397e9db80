"""Cores under deltas and streams of them, diameters by bounds, masks by removals, path weights and singular vectors, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import maintenance, metrics, prep, recommend, structure
from graphloom.streaming import degrees as stream

PAIRS = "u long, v long"


def _graph(seed, n, m):
    rng = np.random.default_rng(seed)
    return sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (m, 2)).tolist() if a != b})


def _cores(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    core, level = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        level = max(level, len(near[v]))
        core[v] = level
        for w in near.pop(v):
            near[w].discard(v)
    return core


def _distances(pairs, start, inside):
    dist, todo = {start: 0}, [start]
    while todo:
        v = todo.pop(0)
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if x == v and y in inside and y not in dist:
                    dist[y] = dist[v] + 1
                    todo.append(y)
    return dist


@pytest.mark.parametrize("n_added,n_removed", [(1, 0), (0, 4), (25, 12), (0, 0)])
def test_updated_cores_are_those_of_the_new_graph(spark, n_added, n_removed):
    pairs = _graph(3, 40, 110) + [(100, 101), (101, 102)]
    rng = np.random.default_rng(n_added + n_removed)
    removed = [pairs[i] for i in rng.permutation(len(pairs))[:n_removed]] + ([(100, 101)] if n_removed else [])
    free = [(a, b) for a in range(44) for b in range(a + 1, 44) if (a, b) not in pairs]
    added = [free[i] for i in rng.permutation(len(free))[:n_added]]
    if n_added > 1:
        added += [(0, 50 + i) for i in range(5) if (0, 50 + i) not in pairs]  # new vertices around one end
    after = sorted(set(pairs) - set(removed) | set(added))
    was = spark.createDataFrame(list(_cores(pairs).items()), "node long, core long")
    got = maintenance.updated_cores(spark.createDataFrame(after, PAIRS), was, spark.createDataFrame(added + added[:1], PAIRS), spark.createDataFrame(removed, PAIRS))
    new = _cores(after)
    assert {r.node: r.core for r in got.collect()} == {v: new.get(v, 0) for v in set(new) | set(_cores(pairs))}


def test_a_lost_edge_unravels_a_ring(spark):
    ring = [(i, i + 1) for i in range(9)] + [(0, 9)]
    was = spark.createDataFrame([(i, 2) for i in range(10)], "node long, core long")
    for n in (1, 3):  # three in a row leave two vertices without edges
        got = maintenance.updated_cores(spark.createDataFrame(ring[n:], PAIRS), was, spark.createDataFrame([], PAIRS), spark.createDataFrame(ring[:n], PAIRS))
        new = _cores(ring[n:])
        assert {r.node: r.core for r in got.collect()} == {v: new.get(v, 0) for v in range(10)}


def test_an_edge_far_away_is_not_searched(spark):
    """Only the subcore of the ends of an added edge is looked at: here a path of core 1 beside a clique."""
    clique = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    path = [(i, i + 1) for i in range(10, 20)] + [(5, 10)]
    edges = spark.createDataFrame([*clique, *path, (10, 20)], PAIRS)
    cores = spark.createDataFrame(list(_cores(clique + path).items()), "node long, core long").withColumn("most", F.col("core") + 1)
    found = maintenance._candidates(structure.adjacency(edges), cores, spark.createDataFrame([(10, 20)], PAIRS))
    assert {r.node for r in found.collect()} == set(range(10, 21))


def test_streams_of_deltas(spark, tmp_path):
    pairs = _graph(8, 25, 60)
    edges = spark.createDataFrame(pairs, PAIRS)
    edges.write.parquet(str(tmp_path / "cores/0/edges"))
    structure.core_numbers(edges).write.parquet(str(tmp_path / "cores/0/cores"))
    structure.degrees(edges).write.parquet(str(tmp_path / "degrees/0"))
    gone, (a, b) = pairs[0], next((a, b) for a in range(25) for b in range(a + 1, 25) if (a, b) not in pairs)
    schema = "at int, op string, u long, v long"
    # Ends in the other order, repeats, a loop, and an edge that goes and comes back.
    rows = [(1, "add", b, a), (2, "add", a, b), (1, "del", *gone), (3, "add", 7, 7), (1, "del", *pairs[5]), (2, "add", *pairs[5])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "deltas"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "deltas"))
    base = str(tmp_path / "cores")
    stream.maintain_cores(read(), base, str(tmp_path / "log")).awaitTermination()
    after = sorted(set(pairs) - {gone} | {(a, b)})
    assert stream.latest(spark, base) == 1
    assert sorted((r.u, r.v) for r in spark.read.parquet(f"{base}/1/edges").collect()) == after
    new = _cores(after)
    assert {r.node: r.core for r in spark.read.parquet(f"{base}/1/cores").collect()} == {v: new.get(v, 0) for e in [*pairs, *after] for v in e}
    # Degrees take deltas as they are: each row counts.
    stream.maintain(read().filter("at = 1 and op = 'del'"), str(tmp_path / "degrees"), str(tmp_path / "log2")).awaitTermination()
    want = {r.node: r.degree for r in structure.degrees(edges).collect()}
    for v in (*gone, *pairs[5]):
        want[v] -= 1
    assert {r.node: r.degree for r in spark.read.parquet(str(tmp_path / "degrees/1")).collect()} == want


def test_diameters_by_bounds(spark):
    path = [(i, i + 1) for i in range(200, 212)]
    pairs = _graph(5, 60, 130) + path
    nodes = sorted({v for e in pairs for v in e if v < 200})
    sets = {"all": nodes, "half": nodes[::2], "path": list(range(200, 213)), "one": [3], "far": [0, 1000], "ring": [*range(300, 309)]}
    pairs += [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    members = spark.createDataFrame([(k, v) for k, c in sets.items() for v in c], "community string, node long")
    edges = spark.createDataFrame([*pairs, (3, 3), pairs[0]], PAIRS)
    for roots, most in ((2, 4), (8, 64)):
        got = {r.community: r.diameter for r in metrics.diameters(edges, members, roots=roots, most=most).collect()}
        for k, c in sets.items():
            far = [_distances(pairs, v, set(c)) for v in c]
            want = max(max(x.values()) for x in far) if all(len(x) == len(c) for x in far) else float("inf")
            assert got[k] == want, (k, got[k], want)
    assert metrics.diameters(edges, members.limit(0)).count() == 0


def test_masks_stay_joined(spark):
    pairs = _graph(6, 50, 120)
    sets = {"a": list(range(25)), "b": list(range(20, 50)), "c": [7]}
    members = spark.createDataFrame([(k, v) for k, c in sets.items() for v in c], "community string, node long")
    edges = spark.createDataFrame(pairs, PAIRS)

    def parts(c):
        return len({min(_distances(pairs, v, set(c))) for v in c})

    seen = set()
    for keep, seed in ((1, 0), (8, 0), (8, 1), (100, 0)):
        got = {}
        for r in prep.masked_by_removals(edges, members, keep, seed).collect():
            got.setdefault(r.community, set()).add(r.node)
        for k, c in sets.items():
            assert got[k] <= set(c) and len(got[k]) == min(keep, len(c)) and parts(got[k]) <= parts(c)
        seen.add(tuple(sorted(got["b"])))
    assert len(seen) == 4  # other seeds remove others
    assert prep.masked_by_removals(edges, members.limit(0), 3).count() == 0


def test_path_weights_and_encodings(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(20, 21)], PAIRS)
    got = {(r.j, r.node): r.x for r in prep.path_weights(edges, spark.createDataFrame([(0,), (4,), (99,)], "node long")).collect()}
    want = {(q, v): 1 / (1 + abs(q - v)) for q in (0, 4) for v in range(9) if abs(q - v) <= 3} | {(99, 99): 1.0}
    assert got == want
    sets = spark.createDataFrame([(5, 1), (5, 1), (5, 2), (6, 2)], "j long, node long")
    assert sorted((r.j, r.node, r.x) for r in prep.set_encodings(sets).collect()) == [(5, 1, 1.0), (5, 2, 1.0), (6, 2, 1.0)]


def test_singular_vectors_of_sparse_rows(spark):
    rng = np.random.default_rng(2)
    matrix = np.where(rng.random((70, 30)) < 0.2, rng.normal(3, 2, (70, 30)), 0.0) + np.outer(rng.random(70), (np.arange(30) < 8) * 9.0)
    matrix[5] = 0
    cells = spark.createDataFrame([(i, j, float(matrix[i, j])) for i in range(70) for j in range(30) if matrix[i, j]], "node long, j long, x double")
    every = spark.range(70).withColumnRenamed("id", "node")
    got = np.zeros((70, 3))
    for r in recommend.truncated(cells, 3, every).collect():
        got[r.node, r.j] = r.x
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    want = u[:, :3] * s[:3]
    want = (want - want.mean(0)) / want.std(0)
    for i in range(3):
        assert abs(np.corrcoef(got[:, i], want[:, i])[0, 1]) > 1 - 1e-4
    assert np.allclose(got.mean(0), 0, atol=1e-9) and np.allclose(got.std(0), 1, atol=1e-9)
    # Few columns: standardised only, and padded with zeros.
    few = {(r.node, r.j): r.x for r in recommend.truncated(cells.filter("j in (4, 9)"), 4, every).collect()}
    four = (matrix[:, [4, 9]] - matrix[:, [4, 9]].mean(0)) / matrix[:, [4, 9]].std(0)
    assert len(few) == 280 and all(abs(few[i, j] - (four[i, j] if j < 2 else 0)) < 1e-9 for i in range(70) for j in range(4))
    assert recommend.truncated(cells.limit(0), 3).count() == 0


def _prim(pairs, members, seed):
    """The members by (largest hash on the best way from the least of their part, steps since, id)."""
    import hashlib

    h = {v: hashlib.md5(f"{seed}|a|{v}".encode()).hexdigest() for v in members}
    near = {v: [b if a == v else a for a, b in pairs if v in (a, b)] for v in members}
    way, todo = {}, sorted(members, key=h.get)
    for start in todo:
        if start not in way:
            way[start] = (h[start], 0)
            front = [start]
            while front:
                ahead = []
                for s in front:
                    for d in near[s]:
                        new = (h[d], 0) if h[d] > way[s][0] else (way[s][0], way[s][1] + 1)
                        if d in members and (d not in way or new < way[d]):
                            way[d] = new
                            ahead.append(d)
                front = ahead
    return sorted(members, key=lambda v: (*way[v], v))


def test_removals_look_at_few_members(spark, monkeypatch):
    """The ways of a set are followed only as far as the members that are kept."""
    pairs, members = _graph(5, 300, 900), set(range(300))
    edges = spark.createDataFrame(pairs, PAIRS)
    sets, seen, whole = spark.createDataFrame([("a", v) for v in members], "community string, node long"), [], prep.fixpoint
    monkeypatch.setattr(prep, "fixpoint", lambda state, *rest: seen.append(state.count()) or whole(state, *rest))
    got = {r.node for r in prep.masked_by_removals(edges, sets, 4).collect()}
    assert got == set(_prim(pairs, members, 0)[:4])
    assert seen[0] < 50 and max(seen) < 300


def test_singular_vectors_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(recommend, "CELLS", 60)
    rng = np.random.default_rng(3)
    matrix = np.where(rng.random((90, 20)) < 0.4, rng.normal(1, 2, (90, 20)), 0.0) + np.outer(rng.random(90), (np.arange(20) < 6) * 9.0)
    cells = spark.createDataFrame([(f"n{i}", f"c{j}", float(matrix[i, j])) for i in range(90) for j in range(20) if matrix[i, j]], "node string, j string, x double")
    got = np.zeros((90, 2))
    for r in recommend.truncated(cells, 2).collect():
        got[int(r.node[1:]), r.j] = r.x
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    for i in range(2):
        assert abs(np.corrcoef(got[:, i], u[:, i] * s[i])[0, 1]) > 1 - 1e-4
