"""Operators on graphs small enough to check by hand."""

import random

import numpy as np
import pytest

from graphloom.operators import analytics, metrics, prep, structure
from graphloom.operators.connectivity import edge_connectivity
from graphloom.operators.search import scored, search
from graphloom.sources.text import canonical, lines, read_edges, read_members, read_snap, write_edges

K4_TAIL = "01 02 03 12 13 23 34 45"
BOWTIE = "01 02 12 23 24 34"
BARBELL = "01 02 12 23 34 35 45"
SHELL_LOW = "01 02 03 12 13 23 45 46 47 56 57 67 08 48"


def graph(spark, text):
    return spark.createDataFrame([(int(e[0]), int(e[1])) for e in text.split()], "u long, v long")


def queries(spark, *nodes):
    return spark.createDataFrame([(0, n) for n in nodes], "query_id long, node long")


def nodes(df):
    return sorted(r.node for r in df.collect())


def test_canonical_edges_and_readers(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("1 2\n2 1\n3 3\n\n# c\n1 2\n")
    assert [tuple(r) for r in read_edges(spark, str(path)).collect()] == [(1, 2)]
    assert canonical(spark.createDataFrame([(None, 1)], "u long, v long")).count() == 0
    path.write_text("9 4 4 \n\n7\n")
    assert sorted(tuple(r) for r in read_members(spark, str(path)).collect()) == [(0, 0, 9), (0, 1, 4), (1, 0, 7)]
    assert [r.value for r in lines(spark, str(path)).orderBy("line_no").collect()] == ["9 4 4", "7"]
    path.write_text("# x\n50 7\n7 3\n")
    edges, ids = read_snap(spark, str(path))
    assert sorted(tuple(r) for r in ids.collect()) == [(0, 50), (1, 7), (2, 3)]
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 1), (1, 2)]
    write_edges(edges, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in read_edges(spark, str(tmp_path / "out")).collect()) == [(0, 1), (1, 2)]


def test_cores_settle_by_moves_of_few_rows(spark, monkeypatch):
    import random

    from graphloom.operators.search import structural as searches

    draw, pairs = random.Random(5), set()
    while len(pairs) < 400:
        a, b = draw.sample(range(90), 2)
        pairs.add((min(a, b) // (1 + a % 3), max(a, b)))
    pairs = {(a, b) for a, b in pairs if a < b}
    g = spark.createDataFrame(sorted(pairs), "u long, v long")
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for p in pairs for x in p}
    core, k = {}, 0
    left = {x: set(n) for x, n in near.items()}
    while left:
        x = min(left, key=lambda y: (len(left[y]), y))
        k = max(k, len(left[x]))
        core[x] = k
        for y in left.pop(x):
            left[y].discard(x)
    assert {r.node: r.core for r in structure.core_numbers(g).collect()} == core
    # No level of a search takes in edges of another one.
    seen, whole = [], searches.components
    monkeypatch.setattr(searches, "components", lambda links, *a, **b: seen.append(links.count()) or whole(links, *a, **b))
    queries = spark.createDataFrame([(x, x) for x in sorted(core, key=core.get)[::30]], "query_id long, node long")
    found = {}
    for r in searches.kcore(g, queries).collect():
        found.setdefault(r.query_id, set()).add(r.node)
    assert len(found) == len(range(0, len(core), 30)) and sum(seen) <= len(pairs)
    for x in found:
        part, todo = {x}, [x]
        while todo:
            new = {y for y in near[todo.pop()] if core[y] >= core[x]} - part
            part |= new
            todo += new
        assert found[x] == part


def test_tasks_grow_with_rows(spark, tmp_path, monkeypatch):
    from graphloom.operators import metrics
    from graphloom.plans import iterate
    from graphloom.sources import derived

    monkeypatch.setattr(iterate, "ROWS", 10, raising=False)
    lines = [(o, (o * 7 + i * i) % 23) for o in range(60) for i in range(5)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    shared = derived.copart_weighted(spark, str(tmp_path))
    orders = [{p for o, p in lines if o == k} for k in range(60)]
    wanted = {(u, v): sum(u in x and v in x for x in orders) for u in range(23) for v in range(u + 1, 23)}
    assert {(r.u, r.v): r.w for r in shared.collect()} == {k: w for k, w in wanted.items() if w}
    assert shared.rdd.getNumPartitions() == 60
    scores = spark.createDataFrame([(q, x, 1.0) for q in range(4) for x in range(50)], "query_id long, node long, score double")
    seen = []
    monkeypatch.setattr(metrics, "dealt", lambda df, rows, *keys: seen.append((rows, keys)) or iterate.dealt(df, rows, *keys), raising=False)
    assert {(r.query_id, r.iou) for r in metrics.soft_overlaps(scores, scores.filter("node < 25")).collect()} == {(q, 0.5) for q in range(4)}
    assert seen == [(200, ("query_id", "node"))]


def test_partners_are_not_sent_through_the_driver(spark, monkeypatch):
    from graphloom.operators import prep

    plans, keep = {}, prep.stored
    monkeypatch.setattr(prep, "stored", lambda df, tag="round": plans.setdefault(tag, df._jdf.queryExecution().executedPlan().toString()) and keep(df, tag))
    edges = keep(spark.createDataFrame([(i, i + k) for i in range(40) for k in (1, 2)], "u long, v long"))
    assert {r.op: r.n for r in prep.edge_deltas(edges).filter("pct = 30").groupBy("op").count().withColumnRenamed("count", "n").collect()} == {"del": 24, "add": 24}
    assert "BroadcastHashJoin [i#" not in plans["added"] and "SortMergeJoin [i#" in plans["added"]


def test_lines_of_several_files(spark, tmp_path):
    for i, n in enumerate((3, 500, 1, 90)):
        (tmp_path / f"part-{i:05}").write_text("# note\n" + "".join(f"{i} {k}\n\n" for k in range(n)))
    wanted = [f"{i} {k}" for i, n in enumerate((3, 500, 1, 90)) for k in range(n)]
    assert [(r.line_no, r.value) for r in lines(spark, str(tmp_path)).orderBy("line_no").collect()] == list(enumerate(wanted))


def test_cores_trusses_triangles_cliques(spark):
    g = graph(spark, K4_TAIL)
    vertices = spark.createDataFrame([(i,) for i in range(7)], "node long")
    assert {r.node: r.core for r in structure.core_numbers(g, vertices).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1, 6: 0}
    assert sorted(r.truss for r in structure.truss_numbers(g).collect()) == [2, 2, 4, 4, 4, 4, 4, 4]
    assert structure.triangles(g).count() == 4
    assert sorted(tuple(r.clique) for r in structure.cliques(g).collect()) == [(0, 1, 2, 3), (3, 4), (4, 5)]
    assert {r.node: round(r.cc, 3) for r in structure.clustering(g).collect()}[3] == 0.5


def test_trusses_keep_one_row_for_each_triangle(spark, monkeypatch):
    """A clique of seven with a triangle and a path hung on: no stored table has more rows than there are triangles or edges."""
    edges = [(a, b) for a in range(7) for b in range(a + 1, 7)] + [(6, 7), (6, 8), (7, 8), (8, 9)]
    sizes, plain = [], structure.stored

    def counted(df, *args):
        out = plain(df, *args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(structure, "stored", counted)
    got = {(r.u, r.v): r.truss for r in structure.truss_numbers(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {e: 7 if e[1] < 7 else 2 if e == (8, 9) else 3 for e in edges}
    assert max(sizes) <= 36


def test_components_paths_forest(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    found = {r.node: r.component for r in structure.components(chain).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[101] == 100
    assert [r.node for r in structure.shortest_path(graph(spark, BARBELL), 0, 5).orderBy("pos").collect()] == [0, 2, 3, 5]
    weighted = spark.createDataFrame([(0, 1, 3), (1, 2, 2), (0, 2, 1)], "u long, v long, w long")
    assert sorted(tuple(r) for r in structure.spanning_forest(weighted).collect()) == [(0, 1, 3), (1, 2, 2)]


def test_searches(spark):
    assert nodes(search("kcore", graph(spark, SHELL_LOW), queries(spark, 8))) == list(range(9))
    assert nodes(search("ktruss", graph(spark, BOWTIE), queries(spark, 2), k=3)) == [0, 1, 2, 3, 4]
    assert nodes(search("ktruss", graph(spark, BOWTIE), queries(spark, 0), k=3)) == [0, 1, 2]
    assert nodes(search("kclique", graph(spark, BOWTIE), queries(spark, 0), k=3)) == [0, 1, 2]
    assert nodes(search("kecc", graph(spark, BARBELL), queries(spark, 0))) == [0, 1, 2]
    assert nodes(search("kecc", graph(spark, BARBELL), queries(spark, 0, 4))) == [0, 1, 2, 3, 4, 5]
    for method in ("lm", "sgm", "dmcs", "qdc", "ppr", "csformer"):
        assert 0 in nodes(search(method, graph(spark, BARBELL), queries(spark, 0), **({"k": 3} if method in ("lm", "qdc") else {})))
    assert nodes(search("lm", graph(spark, BARBELL), queries(spark, 0), k=3)) == [0, 1, 2]


def test_searches_reach_beyond_their_first_candidates(spark):
    rng = np.random.default_rng(3)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 90, (260, 2)).tolist() if a != b} | {(7, i) for i in range(30, 90)}
    g = spark.createDataFrame(sorted(pairs), "u long, v long").cache()
    asked = spark.createDataFrame([(0, 7), (1, 3), (1, 20), (2, 500)], "query_id long, node long").cache()
    scores = spark.createDataFrame([(q, i, i * 37 % 101 / 101) for q in range(3) for i in range(90)], "query_id long, node long, score double")
    ways = {m: lambda size, m=m: search(m, g, asked, size=size) for m in ("lm", "sgm", "dmcs", "qdc", "ppr")}
    ways["heap"] = lambda size: scored.heap_growth(g, asked, scores, top=20, size=size)
    ways["swap"] = lambda size: scored.swap_growth(g, asked, scores, top=12, size=size)
    for name, run in ways.items():
        few, all_ = (sorted(map(tuple, run(size).select("query_id", "node").collect())) for size in (4, 500))
        assert few == all_, name


def test_edge_connectivity_levels(spark):
    got = {tuple(r) for r in edge_connectivity(graph(spark, BARBELL)).collect()}
    assert got == {(0, 1, 2), (0, 2, 2), (1, 2, 2), (2, 3, 1), (3, 4, 2), (3, 5, 2), (4, 5, 2)}


def test_metrics_of_k4_tail(spark):
    g = graph(spark, K4_TAIL)
    pred = spark.createDataFrame([(0, i) for i in range(4)], "query_id long, node long")
    true = spark.createDataFrame([(0, i) for i in range(5)], "query_id long, node long")
    m = metrics.truth_metrics(pred, true, 6).first()
    for name, want in {"pre": 1, "rec": 0.8, "f1": 0.888889, "jac": 0.8, "nmi": 0.403858, "ari": 0.347826}.items():
        assert m[name] == pytest.approx(want, abs=1e-6), name
    s = metrics.structural_metrics(g, pred.withColumnRenamed("query_id", "community")).first()
    want = {"avg_degree": 3, "density": 1, "size": 4, "conductance": 1 / 3, "modularity": 0.08984375, "density_modularity": 0.1796875, "local_modularity": 0.75, "subgraph_modularity": 6, "edge_surplus": 4}
    for name, value in want.items():
        assert s[name] == pytest.approx(value, abs=1e-6), name
    assert metrics.diameters(g, true.withColumnRenamed("query_id", "community")).first().diameter == 2


def test_preparation(spark):
    g = graph(spark, BARBELL)
    sets = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 4), ("b", 5), ("c", 0), ("c", 5)], "community string, node long")
    fixed = prep.repaired(g, sets)
    assert sorted((r.community_id, r.node) for r in fixed.collect()) == [(0, 2), (0, 3), (0, 4), (0, 5)]
    marked = {(r.community, r.node): r.boundary for r in prep.boundary_nodes(g, sets.filter("community = 'a'")).collect()}
    assert marked == {("a", 0): False, ("a", 1): False, ("a", 2): True}
    sample = prep.sample_queries(sets.filter("community <> 'c'"), 4, 2)
    assert sample.groupBy("query_id").count().filter("count <> 2").isEmpty() and sample.select("query_id").distinct().count() == 4
    results = spark.createDataFrame([("q", "a", "1", 0.5), ("q", "b", "1", 0.5), ("r", "a", "2", 0.9), ("r", "b", "1", 0.1)], "query string, method string, thr string, f1 double")
    assert sorted((r.method, r.n_best) for r in analytics.best_methods(results).collect()) == [("a", 2), ("b", 1)]
    assert sorted((r.method, r.n_best) for r in analytics.best_methods(results, exclusive=True).collect()) == [("a", 1), ("b", 0)]
    assert {r.method: r.thr for r in analytics.tuned(results).collect()} == {"a": "2", "b": "1"}


def test_empty_graph(spark):
    g = spark.createDataFrame([], "u long, v long")
    assert structure.core_numbers(g).isEmpty() and structure.components(g).isEmpty() and structure.triangles(g).isEmpty()
    assert structure.edge_support(g).isEmpty() and structure.degrees(g).isEmpty()


def test_diffusions_of_many_queries_agree_with_single_ones(spark):
    g = graph(spark, BARBELL)
    many = spark.createDataFrame([(0, 0), (1, 5), (2, 1), (2, 4)], "query_id long, node long")
    for each, one in ((structure.pagerank_each, structure.pagerank), (structure.proximity_each, structure.proximity)):
        got = {(r.query_id, r.node): r["rank"] for r in each(g, many, rounds=5).collect()}
        for q in (0, 1, 2):
            for r in one(g, many.filter(f"query_id = {q}"), rounds=5).collect():
                assert got.get((q, r.node), 0.0) == pytest.approx(r["rank"], abs=1e-12)


def test_adjacency_kinds_against_matrices(spark):
    a = np.zeros((6, 6))
    for e in K4_TAIL.split():
        a[int(e[0]), int(e[1])] = a[int(e[1]), int(e[0])] = 1
    one = np.eye(6)

    def sym(x):
        return x / np.sqrt(np.outer(x.sum(1), x.sum(1)))

    def row(x):
        return x / x.sum(1)[:, None]

    want = {"none": a, "self": a + one, "sym": sym(a), "aug": sym(a + one), "row": row(a), "aug_row": row(a + one), "first_order": one + sym(a), "aug_plus": one + sym(a + one), "lap": one - sym(a), "row_lap": one - row(a), "laplacian": np.diag(a.sum(1)) - a}
    assert set(want) == set(structure.ADJACENCY_KINDS)
    for kind, matrix in want.items():
        got = np.zeros((6, 6))
        for r in structure.normalised_adjacency(graph(spark, K4_TAIL), kind).collect():
            got[r.s, r.d] += r.w
        assert np.allclose(got, matrix), kind
    excess = {(r.node, r.hop): (r.excess, r.keep) for r in structure.conductance_hops(graph(spark, K4_TAIL), 2).collect()}
    columns = [x.sum(0) - np.sign(x).sum(0) for x in (a @ a, a @ a @ a, a @ a @ a @ a)]
    assert {k: v[0] for k, v in excess.items()} == {(n, h): columns[h][n] for n in range(6) for h in range(3)}
    best = np.argmax(columns, axis=0)
    assert all(keep == (0 if h > best[n] and best[n] else 1) for (n, h), (_, keep) in excess.items())


def test_free_riders_soft_overlaps_and_trimmed_cores(spark):
    g = graph(spark, K4_TAIL)
    ones = spark.createDataFrame([(i, 1.0) for i in range(6)], "node long, w double")
    sets = spark.createDataFrame([("a", n) for n in (0, 1, 2, 4, 5)] + [("b", 5)], "community string, node long")
    got = {(r.community, r.part): (r.n, r.density, r.main) for r in metrics.free_riders(g, sets, ones).collect()}
    assert got == {("a", 0): (3, 1.0, True), ("a", 4): (2, 0.5, False), ("b", 5): (1, 0.0, True)}
    assert nodes(structure.biased_core(g, ones, 2.0)) == [0, 1, 2, 3] and nodes(structure.biased_core(g, ones, 4.0)) == []
    scores = spark.createDataFrame([(0, 1, 0.8), (0, 2, 0.6), (0, 3, 0.1)], "query_id long, node long, score double")
    truth = spark.createDataFrame([(0, 1), (0, 4)], "query_id long, node long")
    r = metrics.soft_overlaps(scores, truth).first()
    assert (r.iou, r.f1) == (pytest.approx(0.8 / 2.7), 0.5)
    vectors = {(r.node, r.h): r.share for r in structure.h_index_vectors(graph(spark, "01 12")).collect()}
    assert vectors == {(n, 1): 1.0 for n in range(3)}


def test_distinct_edges_grow_in_tasks(spark, monkeypatch):
    from graphloom.plans import iterate
    from graphloom.sources.text import canonical

    monkeypatch.setattr(iterate, "ROWS", 100)
    raw = spark.range(1000).selectExpr("id % 50 as a", "id % 31 as b")
    edges = canonical(raw, "a", "b")
    both = structure.add_edges(edges, spark.createDataFrame([(1, 900), (0, 1)], "u long, v long"))
    want = {(min(i % 50, i % 31), max(i % 50, i % 31)) for i in range(1000) if i % 50 != i % 31}
    assert {(r.u, r.v) for r in both.collect()} == want | {(1, 900), (0, 1)} and both.count() == len(want | {(1, 900), (0, 1)})
    assert edges.rdd.getNumPartitions() == 10 and both.rdd.getNumPartitions() >= both.count() // 100


def test_edges_are_not_shuffled_for_few_queries(spark, tmp_path, monkeypatch):
    """Also where the table that the queries come from is past Spark's bound for sending, which none is here."""
    from graphloom.plans import iterate
    from graphloom.queries import relational

    monkeypatch.setattr(iterate, "ROWS", 10)
    plans = []
    lines = [(o, (o * 7 + i * i) % 23) for o in range(60) for i in range(5)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(p, f"b{p % 3}") for p in range(23)], "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(relational, "stored", lambda df, tag="round": plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or iterate.stored(df, tag))
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = relational.predictions(spark, str(tmp_path))
        plans.append(("all", got._jdf.queryExecution().executedPlan().toString()))
        rows = {(r.method, r.thr, r.query_id, r.node) for r in got.collect()}
        relational.measured(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    orders = [{p for o, p in lines if o == k} for k in range(60)]
    near = {(t, u): {v for v in range(23) if v != u and sum(u in x and v in x for x in orders) >= t} | {u} for t in (1, 2, 3) for u in range(23)}
    want = {("hop1", str(t), q, v) for t in (1, 2, 3) for q in range(3) for v in near[t, q]}
    want |= {("hop2", str(t), q, v) for t in (2, 3) for q in range(3) for m in near[t, q] for v in near[t, m]}
    assert rows == want
    assert not [tag for tag, plan in plans if tag != "measured" and "SortMergeJoin" in plan]
    assert "REPARTITION_BY_NUM" in plans[-1][1]


def test_scaled_degree_profile_does_not_depend_on_the_order_of_rows(spark):
    """Bits, not near values: a rounded score near a tie goes up or down by its last digits."""
    rng = random.Random(5)
    edges = spark.createDataFrame(sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(3000)}), "u long, v long")
    adaptive, shuffles = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = []
        for n in (1, 3):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append({r.node: tuple(r) for r in structure.degree_profile(edges.repartition(n), scaled=True).collect()})
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert found[0] == found[1]
    for c in range(1, 6):
        column = [r[c] for r in found[0].values()]
        assert abs(sum(column)) < 1e-9 and abs(sum(x * x for x in column) / len(column) - 1) < 1e-12
