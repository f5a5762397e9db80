"""Preparation of datasets: community repair, splits, query sampling, ground-truth repair, stress variants. Sampling goes by seeded hashes, so reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import scaled
from ..plans.iterate import discard, few, fixpoint, ranked, stored
from .structure import adjacency, bfs, components, core_numbers


def _draw(*columns: str, seed: int):
    """A hash of the seed and the columns that other engines can compute too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def _number(drawn):
    """60 bits of a draw as a number."""
    return F.conv(F.substring(drawn, 1, 15), 16, 10).cast("long")


def connected_parts(edges: DataFrame, communities: DataFrame, least: int = 3) -> DataFrame:
    """``community, part, node``: the connected parts of each community inside the graph, of ``least`` vertices or more."""
    member = communities.select("community", "node").distinct()
    inner = edges.join(member.withColumnRenamed("node", "u"), "u").join(member.withColumnRenamed("node", "v"), ["community", "v"]).select("community", "u", "v")
    label = stored(components(inner, member, by=["community"]).withColumnRenamed("component", "part"), "parts")
    large = label.groupBy("community", "part").count().filter(F.col("count") >= least)
    return label.join(large.select("community", "part"), ["community", "part"]).select("community", "part", "node")


def repaired(edges: DataFrame, communities: DataFrame, least: int = 3, rounds: int = 100) -> DataFrame:
    """``community_id, node``: connected, disjoint communities. Vertices go to the largest part that wants them (ties: least vertex, then name); what is left of the others is split again.

    Each round settles every part that is first choice of all its vertices, so disjoint input needs one round.
    """
    parts = stored(connected_parts(edges, communities, least), "parts")
    done = None
    for _ in range(rounds):
        if parts.isEmpty():
            break
        size = parts.groupBy("community", "part").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"))
        keyed = parts.join(size, ["community", "part"]).withColumn("rank", F.struct(-F.col("n"), F.col("low"), F.col("community"), F.col("part")))
        first = keyed.withColumn("best", F.min("rank").over(Window.partitionBy("node")))
        lost = first.filter("rank <> best").select("community", "part").distinct()
        safe = stored(first.join(lost, ["community", "part"], "left_anti").select("community", "part", "node"), "safe")
        done = safe if done is None else done.unionByName(safe)
        rest = parts.join(safe.select("community", "part").distinct(), ["community", "part"], "left_anti").join(safe.select("node").distinct(), "node", "left_anti")
        named = rest.select(F.concat_ws("/", "community", "part").alias("community"), "node")
        parts = stored(connected_parts(edges, named, least).withColumn("community", F.col("community").cast("string")), "parts")
        done = done.withColumn("community", F.col("community").cast("string"))
    else:
        raise RuntimeError("communities still overlap")
    if done is None:
        return parts.select(F.col("part").alias("community_id"), "node")
    size = done.groupBy("community", "part").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"))
    order = size.withColumn("community_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "low")) - 1)  # one row for each community
    return done.join(order.select("community", "part", "community_id"), ["community", "part"]).select("community_id", "node")


def split_communities(communities: DataFrame, share: float = 0.5, seed: int = 0) -> DataFrame:
    """``community, side``: train or test, by the hash of the community."""
    w = Window.partitionBy(F.lit(0)).orderBy(_draw("community", seed=seed), "community")  # one row for each community
    ids = communities.select("community").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return ids.select("community", F.when(F.row_number().over(w) <= F.ceil(n * share), "train").otherwise("test").alias("side"))


def sample_queries(communities: DataFrame, n: int, size: int = 1, seed: int = 0) -> DataFrame:
    """``query_id, pos, node, community``: ``n`` queries of ``size`` vertices. Communities take turns in hash order; one with too few unused vertices reuses them."""
    order = Window.partitionBy("community").orderBy(_draw("community", "node", seed=seed), "node")
    ranked = communities.select("community", "node").distinct().withColumn("r", F.row_number().over(order) - 1)
    sizes = ranked.groupBy("community").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= size)
    turn = sizes.withColumns({"t": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(_draw("community", seed=seed), "community")) - 1, "k": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    queries = turn.filter(F.col("t") < n).withColumn("query_id", F.explode(F.sequence(F.col("t").cast("long"), F.lit(n - 1).cast("long"), F.col("k").cast("long"))))
    wanted = queries.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("r", ((F.floor(F.col("query_id") / F.col("k")) * size + F.col("pos")) % F.col("m")).cast("int"))
    return wanted.join(ranked, ["community", "r"]).select("query_id", "pos", "node", "community")


def nested_queries(queries: DataFrame, sizes=(1, 2, 4, 6, 8)) -> DataFrame:
    """``qsize, query_id, pos, node``: prefixes of one query, which share its ground truth."""
    return queries.withColumn("qsize", F.explode(F.array(*[F.lit(s) for s in sizes]))).filter(F.col("pos") < F.col("qsize")).select("qsize", "query_id", "pos", "node")


def boundary_nodes(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """``community, node, boundary``: whether a member has a neighbour outside its community."""
    member = communities.select("community", "node").distinct()
    out = adjacency(edges).join(member.withColumnRenamed("node", "s"), "s").join(member.select("community", F.col("node").alias("d")), ["community", "d"], "left_anti")
    edge = out.select("community", F.col("s").alias("node")).distinct().withColumn("boundary", F.lit(True))
    return member.join(edge, ["community", "node"], "left").select("community", "node", F.coalesce("boundary", F.lit(False)).alias("boundary"))


def boundary_pairs(edges: DataFrame, communities: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``pair, community, boundary_node, interior_node``: one vertex of each kind from the same community, ``n`` + 1 pairs at most."""
    marked = boundary_nodes(edges, communities)
    ranked = marked.withColumn("r", F.row_number().over(Window.partitionBy("community", "boundary").orderBy(_draw("community", "node", seed=seed), "node")))
    a, b = ranked.filter("boundary").select("community", "r", F.col("node").alias("boundary_node")), ranked.filter("not boundary").select("community", "r", F.col("node").alias("interior_node"))
    pairs = a.join(b, ["community", "r"])
    return pairs.orderBy("r", _draw("community", seed=seed), "community").limit(n + 1).select("community", "boundary_node", "interior_node")


def repaired_truth(edges: DataFrame, queries: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and truths, where a truth is the connected part that holds its whole query; queries without one go."""
    by = truth.select(F.col("query_id").alias("community"), "node")
    part = stored(connected_parts(edges, by, 1), "truth")
    need = queries.groupBy("query_id").agg(F.count_distinct("node").alias("need"))
    hit = queries.join(part.withColumnRenamed("community", "query_id"), ["query_id", "node"]).groupBy("query_id", "part").agg(F.count_distinct("node").alias("has")).join(need, "query_id").filter("has = need")
    kept = part.withColumnRenamed("community", "query_id").join(hit.select("query_id", "part"), ["query_id", "part"]).select("query_id", "node")
    return queries.join(hit.select("query_id").distinct(), "query_id", "left_semi"), kept


def member_distances(edges: DataFrame, queries: DataFrame, truth: DataFrame) -> DataFrame:
    """``query_id, node, dist``: members of each truth by their distance from its query, over edges inside the truth."""
    by = truth.select("query_id", "node")
    inner = edges.join(by.withColumnRenamed("node", "u"), "u").join(by.withColumnRenamed("node", "v"), ["query_id", "v"]).select("query_id", "u", "v")
    two = inner.select("query_id", F.col("u").alias("s"), F.col("v").alias("d")).unionByName(inner.select("query_id", F.col("v").alias("s"), F.col("u").alias("d")))
    two = stored(two, "inner")
    seen = stored(queries.select("query_id", "node").distinct().withColumn("dist", F.lit(0)), "seen")
    front, dist = seen, 0
    while not front.isEmpty():
        dist += 1
        step = front.select("query_id", F.col("node").alias("s")).join(two, ["query_id", "s"]).select("query_id", F.col("d").alias("node")).distinct()
        front = stored(step.join(seen, ["query_id", "node"], "left_anti").withColumn("dist", F.lit(dist)), "front")
        seen = seen.unionByName(front)
    return seen.select("query_id", "node", "dist")


def nearest_members(edges: DataFrame, queries: DataFrame, truth: DataFrame, keep: int) -> DataFrame:
    """``query_id, node``: the ``keep`` members of each truth nearest to its query by (distance, id); such a set stays connected in a connected truth."""
    order = Window.partitionBy("query_id").orderBy("dist", "node")
    return member_distances(edges, queries, truth).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).select("query_id", "node")


def masked_by_removals(edges: DataFrame, sets: DataFrame, keep: int, seed: int = 0) -> DataFrame:
    """``community, node``: what is left of each set after members are removed in random order until ``keep`` are left; no removal parts what was joined.

    Each connected part starts from its member of least hash and takes in the rest by the least hash that borders on it, as a spreading fluid
    does. Removals run backwards through that order, so each takes a vertex that is no cut vertex of what is left. The order is (the largest
    hash that the best way from the start must pass, steps since that vertex, id), a fixpoint of joins for all sets at once.

    Ways that pass no hash above a bound lie among the vertices within it, so the fixpoint goes over these only. Every other vertex comes
    after those that it reaches; a set in which it reaches fewer than ``keep`` is looked at again with a bound four times as high.
    """
    member = sets.select("community", "node").distinct()
    inner = edges.filter("u <> v").join(member.withColumnRenamed("node", "u"), "u").join(member.withColumnRenamed("node", "v"), ["community", "v"]).select("community", "u", "v")
    inner = stored(inner, "inner")
    drawn = components(inner, member, by=["community"]).withColumn("h", _draw("community", "node", seed=seed))
    least = drawn.groupBy("community", "component").agg(F.min(F.struct("h", "node")).alias("least"))
    start = drawn.join(least, ["community", "component"]).select("community", "node", "h", F.when(F.col("node") == F.col("least.node"), F.struct(F.col("h").alias("pass"), F.lit(0).alias("steps"))).alias("way"))
    start = stored(start, "starts")
    arcs = inner.withColumn("far", F.greatest(_number(_draw("community", "u", seed=seed)), _number(_draw("community", "v", seed=seed))))
    arcs = stored(arcs, "arcs")
    discard(inner)
    todo = start.groupBy("community").agg(F.count(F.lit(1)).alias("n")).withColumn("bound", F.floor(F.least(F.lit(1.0), F.lit(4.0 * keep) / F.col("n")) * 2.0**60))
    todo, out = stored(todo, "todo"), None
    while (sets_left := todo.count()) > 0:
        part = few(todo.select("community", "bound"), sets_left)
        ways = _ways(arcs.join(part, "community").filter("far <= bound"), start.join(part, "community").filter(_number(F.col("h")) <= F.col("bound")).select(*start.columns))
        met = todo.join(ways.filter("way is not null").groupBy("community").agg(F.count(F.lit(1)).alias("met")), "community", "left").withColumn("met", F.coalesce("met", F.lit(0)))
        done = F.col("met") >= F.least(F.lit(keep), F.col("n"))
        met = stored(met, "met")
        order = Window.partitionBy("community").orderBy("way.pass", "way.steps", "node")
        found = ways.filter("way is not null").join(few(met.filter(done).select("community"), sets_left), "community", "left_semi")
        found = stored(found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).select("community", "node"), "left")
        out = found if out is None else out.unionByName(found)
        todo = stored(met.filter(~done).select("community", "n", F.least(F.col("bound") * 4, F.lit(2**60)).alias("bound")), "todo")
    return out if out is not None else member


def _ways(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """``community, node, h, way``: for each vertex of ``start`` the least (largest hash, steps since) of the ways along ``arcs`` from those that have one already."""
    two = arcs.select("community", F.col("u").alias("s"), F.col("v").alias("d")).unionByName(arcs.select("community", F.col("v").alias("s"), F.col("u").alias("d")))
    two = stored(two, "arcs")

    def step(state: DataFrame) -> DataFrame:
        ahead = state.filter("way is not null").select("community", F.col("node").alias("s"), "way").join(two, ["community", "s"]).select("community", F.col("d").alias("node"), F.col("way").alias("w"))
        met = ahead.join(state.select("community", "node", "h"), ["community", "node"])
        through = F.when(F.col("h") > F.col("w.pass"), F.struct(F.col("h").alias("pass"), F.lit(0).alias("steps"))).otherwise(F.struct(F.col("w.pass").alias("pass"), (F.col("w.steps") + 1).alias("steps")))
        best = met.groupBy("community", "node").agg(F.min(through).alias("new"))
        after = state.withColumnRenamed("way", "before").join(best, ["community", "node"], "left")
        return after.select("community", "node", "h", F.least("before", "new").alias("way"), "before")

    return fixpoint(start, step, "not (way <=> before)")


def path_weights(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """``node, j, x``: for each seed j (node), 1 / (1 + distance) of the vertices within ``depth`` steps. Spread over the graph by ``structure.propagate``, it stands for the seed among features."""
    from .structure import discard

    adj = stored(adjacency(edges).distinct(), "adj")
    seen = stored(seeds.select(F.col("node").alias("j"), "node", F.lit(1.0).alias("x")).distinct(), "paths")
    front = seen
    for far in range(1, depth + 1):
        step = front.select("j", F.col("node").alias("s")).join(adj, "s").select("j", F.col("d").alias("node")).distinct()
        front = stored(step.join(seen.select("j", "node"), ["j", "node"], "left_anti").withColumn("x", F.lit(1.0 / (1 + far))), "paths")
        seen = seen.unionByName(front)
    out = stored(seen.select("node", "j", "x"), "paths")
    discard(adj)
    return out


def set_encodings(sets: DataFrame) -> DataFrame:
    """``node, j, x``: 1 for each member of each set (j, node), to be spread by ``structure.propagate``."""
    return sets.select("node", "j", F.lit(1.0).alias("x")).distinct()


def structural_features(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``node, core, feat``: core numbers scaled to 0..1."""
    return scaled(core_numbers(edges, vertices).withColumn("feat", F.col("core")), "feat").select("node", "core", "feat")


def row_normalised(features: DataFrame) -> DataFrame:
    """``node, j, x``: x over the sum of its row; 0 where that is 0."""
    total = F.sum("x").over(Window.partitionBy("node"))
    return features.select("node", "j", F.when(total != 0, F.col("x") / total).otherwise(0.0).alias("x"))


def vertex_samples(vertices: DataFrame, percents=(20, 40, 60, 80), seed: int = 0) -> DataFrame:
    """``pct, node``: nested samples by one hash order; of n vertices, floor(n pct / 100). One pass gives every vertex its rank in that order."""
    nodes = vertices.select("node").distinct()
    n = nodes.count()
    return _nested(ranked(nodes, _draw("node", seed=seed), "node"), n, percents).select("pct", "node")


def _nested(rows: DataFrame, n: int, percents) -> DataFrame:
    """``rows`` with ``pct``, once for each percentage of n that its ``_rank`` lies within."""
    sizes = F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.lit(n * p // 100).alias("k")) for p in percents]))
    return rows.withColumn("_s", sizes).filter(F.col("_rank") < F.col("_s.k")).withColumn("pct", F.col("_s.pct"))


def edge_deltas(edges: DataFrame, percents=(10, 20, 30), seed: int = 0) -> DataFrame:
    """``op, pct, u, v``: nested samples of edges to delete, and as many pairs that are no edges to add (all there are, if fewer)."""
    n = edges.count()
    gone = edges.select("u", "v", _draw("u", "v", seed=seed).alias("h"))
    nodes = stored(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    v = nodes.count()
    pairs = v * (v - 1) // 2
    need = min(n * max(percents) // 100, pairs - n)
    placed = stored(ranked(nodes, "node").select("node", F.col("_rank").alias("r")), "placed")
    partners = 2 * need // max(1, v) + 2
    while True:
        # Each vertex draws partners by hash. Where the graph has a fourth of all pairs or more, all pairs are at most four times its edges and stand as they are.
        every = pairs <= 4 * n
        drawn = placed.withColumn("i", F.explode(F.sequence(F.col("r") + 1, F.lit(v - 1)) if every else F.sequence(F.lit(0), F.lit(partners - 1))))
        drawn = drawn.filter(F.col("i") > F.col("r")) if every else drawn.withColumn("i", _number(_draw("node", "i", seed=seed + 100)) % v)
        other = placed.select(F.col("node").alias("other"), F.col("r").alias("i"))
        new = drawn.join(other.hint("merge"), "i").filter("node <> other").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
        new = stored(new.join(edges, ["u", "v"], "left_anti"), "added")
        if every or new.count() >= need:
            break
        partners *= 2
    out = None
    for op, rows in (("del", gone), ("add", new.withColumn("h", _draw("u", "v", seed=seed + 1)))):
        part = _nested(ranked(rows, "h", "u", "v"), n, percents).select(F.lit(op).alias("op"), "pct", "u", "v")
        out = part if out is None else out.unionByName(part)
    return out


def inductive_samples(communities: DataFrame, sizes=(("train", 150), ("valid", 100), ("test", 100)), seed: int = 0) -> DataFrame:
    """``split, query_id, node, community``: queries of one vertex. Communities are split in two; train and valid queries come from the one side, test queries from the other."""
    sides, out = split_communities(communities, seed=seed), None
    for i, (split, n) in enumerate(sizes):
        side = sides.filter(F.col("side") == ("test" if split == "test" else "train"))
        drawn = sample_queries(communities.join(side.select("community"), "community", "left_semi"), n, seed=seed + i)
        part = drawn.select(F.lit(split).alias("split"), "query_id", "node", "community")
        out = part if out is None else out.unionByName(part)
    return out


def random_queries(vertices: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``query_id, pos, node``: n queries of one, two or three vertices (7, 2 and 1 of ten by the hash of the query), where a dataset has none."""
    size = F.expr(f"conv(substring(md5('{seed}|' || query_id), 1, 8), 16, 10) % 10")
    asked = vertices.sparkSession.range(n).withColumnRenamed("id", "query_id").withColumn("size", F.when(size < 7, 1).when(size < 9, 2).otherwise(3))
    total = vertices.count()
    order = ranked(vertices.select("node"), _draw("node", seed=seed), "node")
    wanted = asked.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).withColumn("_rank", (F.col("query_id") * 3 + F.col("pos")) % total)
    return wanted.join(order, "_rank").select("query_id", "pos", "node")


def node_splits(vertices: DataFrame, train: float = 0.6, valid: float = 0.2, seed: int = 0) -> DataFrame:
    """``node, split``: by hash order, the first share is train, the next valid, the rest test."""
    n = vertices.count()
    rank = F.col("_rank")
    return ranked(vertices.select("node"), _draw("node", seed=seed), "node").select("node", F.when(rank < F.floor(F.lit(n * train)), "train").when(rank < F.floor(F.lit(n * (train + valid))), "valid").otherwise("test").alias("split"))


def class_splits(labels: DataFrame, per_class: int = 20, seed: int = 0) -> DataFrame:
    """``node, label, split``: of each class the first ``per_class`` vertices by hash are train, as many more valid, the rest test."""
    r = F.row_number().over(Window.partitionBy("label").orderBy(_draw("node", seed=seed), "node"))
    return labels.select("node", "label", F.when(r <= per_class, "train").when(r <= 2 * per_class, "valid").otherwise("test").alias("split"))


def attached(edges: DataFrame, n: int, degree: int, seed: int = 0) -> DataFrame:
    """``u, v``: the graph with n new vertices (negative ids), each with up to ``degree`` edges to vertices drawn by hash."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    total = nodes.count()
    order = ranked(nodes, _draw("node", seed=seed), "node")
    made = edges.sparkSession.range(1, n + 1).select((-F.col("id")).alias("u"), F.explode(F.sequence(F.lit(0), F.lit(degree - 1))).alias("i"))
    made = made.withColumn("_rank", _number(_draw("u", "i", seed=seed)) % total)
    return edges.select("u", "v").unionByName(made.join(order, "_rank").select("u", F.col("node").alias("v")).distinct())


def without_core_class(edges: DataFrame, cores: DataFrame, low: int, high: int, share: float, seed: int = 0) -> DataFrame:
    """``u, v``: the graph without a ``share`` (by hash order) of the vertices whose core number lies in ``low`` .. ``high``."""
    chosen = cores.filter(F.col("core").between(low, high)).select("node")
    n = chosen.count()
    gone = ranked(chosen, _draw("node", seed=seed), "node").filter(F.col("_rank") < int(n * share)).select("node")
    return edges.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v")


def positive_samples(queries: DataFrame, truth: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """``query_id, node``: k members of each truth by hash, none of them in the query."""
    rest = truth.join(queries.select("query_id", "node"), ["query_id", "node"], "left_anti")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(_draw("query_id", "node", seed=seed), "node"))
    return rest.withColumn("r", r).filter(F.col("r") <= k).select("query_id", "node")


def rollout_samples(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """``community, step, node, frontier``: members in breadth order from the smallest, and how many members border on those before. A model learns the next from (before, frontier)."""
    member = communities.select(F.col("community").alias("query_id"), "node").distinct()
    first = member.groupBy("query_id").agg(F.min("node").alias("node"))
    order = Window.partitionBy("query_id").orderBy("dist", "node")
    found = stored(member_distances(edges, first, member).withColumn("step", F.row_number().over(order) - 1), "rollout")
    near = adjacency(edges).join(found.select("query_id", F.col("node").alias("s"), F.col("step").alias("a")), "s").join(found.select("query_id", F.col("node").alias("d"), F.col("step").alias("b")), ["query_id", "d"])
    since = near.groupBy("query_id", F.col("d").alias("node")).agg(F.min("a").alias("since"))
    # A member borders on the first t members from the step after its earliest neighbour until it joins: one more from there on, one less after it has joined.
    waits = found.join(since, ["query_id", "node"]).filter("step > 0 and since < step")
    turns = waits.select("query_id", F.explode(F.array(F.struct((F.col("since") + 1).alias("step"), F.lit(1).alias("more")), F.struct((F.col("step") + 1).alias("step"), F.lit(-1).alias("more")))).alias("t"))
    counted = turns.groupBy("query_id", "t.step").agg(F.sum("t.more").alias("more"))
    frontier = F.sum(F.coalesce("more", F.lit(0))).over(Window.partitionBy("query_id").orderBy("step"))
    return found.join(counted, ["query_id", "step"], "left").select(F.col("query_id").alias("community"), "step", "node", frontier.alias("frontier"))


def random_walks(edges: DataFrame, starts: DataFrame, length: int = 3, seed: int = 0) -> DataFrame:
    """``walk, step, node``: from each start the neighbour with the least hash of (walk, step, neighbour), again and again."""
    adj = stored(adjacency(edges), "adj")
    now = stored(starts.select(F.col("node").alias("walk"), F.lit(0).alias("step"), "node"), "walks")
    out = now
    for i in range(1, length + 1):
        ahead = now.select("walk", F.col("node").alias("s")).join(adj, "s").withColumn("step", F.lit(i))
        now = stored(ahead.groupBy("walk", "step").agg(F.min(F.struct(_draw("walk", "step", "d", seed=seed).alias("h"), "d")).alias("m")).select("walk", "step", F.col("m.d").alias("node")), "walks")
        out = out.unionByName(now)
    return out


def neighbours_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Open neighbourhood of a set."""
    near = bfs(edges, nodes, limit=1)
    return near.filter("dist = 1").select("node")
