import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions.numbering import numbered
from pathloom.functions.scalars import has_bit
from pathloom.operators import frequency, graph, monotone, planner, sessions
from pathloom.plans import experiments
from pathloom.sources import tables as src


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def frontier_of(spark, pairs, state):
    edges = edges_of(spark, pairs)
    nodes = graph.nodes(None, edges)
    mastered = spark.createDataFrame([(1, n) for n in state], "user_id long, node_id long")
    users = spark.createDataFrame([(1,)], "user_id long")
    return sorted(r.node_id for r in graph.frontier(nodes, edges, mastered, users).collect())


DAG, LOOP = [(0, 1), (0, 2), (2, 3)], [(0, 1), (1, 2), (2, 0)]


@pytest.mark.parametrize("pairs,state,want", [(DAG, [], [0]), (DAG, [0], [1, 2]), (DAG, [0, 2], [1, 3]), (DAG, [0, 1, 2, 3], []), (LOOP, [], [0]), (LOOP, [0], [1]), ([(0, 2), (1, 2)], [], [0, 1])])
def test_frontier(spark, pairs, state, want):
    assert frontier_of(spark, pairs, state) == want


def test_graph(spark):
    edges = edges_of(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (0, 1)])
    nodes = graph.nodes(None, edges)
    assert {r.node_id: r.depth for r in graph.depths(nodes, edges).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    assert graph.edge_index(nodes, edges).count() == 5 and graph.adjacency(edges).count() == 4
    graph.check_dag(edges)
    with pytest.raises(ValueError, match="cycles"):
        graph.check_dag(edges_of(spark, [(0, 1), (1, 1)]))
    assert graph.subgraph(nodes, edges.distinct(), 3)[1].count() == 2
    assert planner.sampled_targets(nodes, 9).count() == 4 and planner.sampled_targets(nodes, 2).collect() == planner.sampled_targets(nodes, 2).collect()


def toy_setup(spark):
    edges = src.edge_list(spark, toy=True)
    nodes = graph.nodes(src.item_map(spark, toy=True), edges)
    sampled = sessions.samples(sessions.sessions(sessions.with_nodes(src.toy_log(spark), src.item_map(spark, toy=True))))
    return nodes, edges, frequency.fit(sampled, nodes), sampled


def test_published_plans(spark):
    nodes, edges, freq, _ = toy_setup(spark)
    targets = nodes.where("node_id > 0").select("node_id")
    s = [experiments.Strategy("freq_dp", planner.frequency_estimator(freq.cache()))]
    got = {r.target_node: r for r in experiments.trajectories(s, targets, nodes, edges).collect()}
    want = {1: (207.5, [0, 1], 1, 0.833333), 2: (307.5, [0, 2], 2, 0.5), 3: (702.5, [0, 1, 2, 3], 3, 0.25)}
    for t, (cost, path, node, p) in want.items():
        assert abs(got[t].expected_total_cost - cost) < 1e-6 and got[t].path == path and tuple(got[t].bottleneck_node) == (node, p)


def certain(base):
    """An estimator of steps that never fail and take ``base``."""
    return planner.Estimator(lambda steps: steps.withColumns({"p": F.lit(1.0), "var": F.lit(0.0), "t_base": base}))


def test_trap(spark):
    """Going to 1 first is cheap, but makes the last step cost 100."""
    nodes = graph.nodes(None, edges_of(spark, DAG))
    g = planner.prepare(nodes, edges_of(spark, DAG))
    plans = planner.plans_for(spark.createDataFrame([(3,)], "node_id long"), g).withColumn("state", F.array(F.lit(1).cast("long")))
    base = F.when(F.col("idx") == 1, 1.0).when((F.col("idx") == 3) & has_bit(F.col("state"), F.lit(1)), 100.0).otherwise(5.0)
    dp, greedy = planner.dp_plans(plans, g, certain(base)).first(), planner.greedy_plans(plans, g, certain(base)).first()
    assert (dp.total_cost, dp.path) == (10.0, [2, 3]) and (greedy.total_cost, greedy.path) == (106.0, [1, 2, 3])


def brute_plan(ids, pairs, goal, cost, had=frozenset()):
    """The least (cost, path) over all orders of all sets of nodes; cost(state, node)."""
    best = (math.inf, [])
    for size in range(len(ids) + 1):
        for order in itertools.permutations([x for x in ids if x not in had], size):
            states = [had | set(order[:k]) for k in range(size + 1)]
            ends = [k for k, s in enumerate(states) if goal <= s]
            if ends != [size] or any(a not in states[k] for k, x in enumerate(order) for a, b in pairs if b == x):
                continue
            best = min(best, (round(sum(cost(states[k], x) for k, x in enumerate(order)), 9), list(order)))
    return best


def test_dp_against_enumeration(spark):
    """Costs that depend on the state in any way, one goal and several, from nothing and from a user's own state; both ways to find the next nodes."""
    r = random.Random(3)
    n = 5
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.4] or [(0, 1)]
    edges = edges_of(spark, pairs)
    nodes = graph.nodes(edges.select(F.col("src").alias("node_id")).union(spark.range(n).select("id")), edges)
    base = {(i, s): 1 + (i * 7 + s * 3) % 11 for i in range(n) for s in range(1 << n)}
    table = spark.createDataFrame([(i, [s], float(c)) for (i, s), c in base.items()], "idx long, state array<bigint>, t_base double")
    score = planner.Estimator(lambda steps: steps.join(F.broadcast(table), ["idx", "state"]).withColumns({"p": F.lit(1.0), "var": F.lit(0.0)}))
    cost = lambda state, x: base[x, sum(1 << y for y in state)]
    cases = [(1, set(), {4}), (2, {0}, {3, 4}), (3, {1}, {2}), (4, {4}, {4}), (5, {0, 1, 2, 3, 4}, {1, 2}), (6, {0}, {3, 4})]
    frame = lambda k: spark.createDataFrame([(c[0], x) for c in cases for x in c[k]], "user_id long, node_id long")
    for most_bytes in (planner.MOST_BYTES, 0):
        g = planner.prepare(nodes, edges, most_bytes)
        users, plans = planner.user_plans(frame(1), frame(2), g)
        assert plans.count() == 5 and users.count() == 6
        got = {r.user_id: (r.total_cost, r.path) for r in users.join(planner.dp_plans(plans, g, score), "plan_id").collect()}
        assert got == {u: brute_plan(range(n), pairs, goal, cost, had) for u, had, goal in cases}
        greedy = {r.user_id: r.total_cost for r in users.join(planner.greedy_plans(plans, g, score), "plan_id").collect()}
        assert all(greedy[u] >= got[u][0] for u in got)


def test_bounds_lose_no_plan(spark):
    """A monotone model's plans with and without the bound from the largest chances, against all orders."""
    r = random.Random(8)
    n, pairs = 6, [(0, 3), (1, 3), (3, 5), (2, 4)]
    rows = [(s, i, r.uniform(-1, 3), r.uniform(0, 2.5), 0.1, 0.7) for s in range(3) for i in range(n)]
    table = spark.createDataFrame(rows, "pass int, idx long, diff double, pre double, able double, w double")
    edges = edges_of(spark, pairs)
    nodes, score = graph.nodes(None, edges), monotone.estimator(table)
    g = planner.prepare(nodes, edges)
    plans = planner.plans_for(spark.createDataFrame([(5,), (4,), (3,)], "node_id long"), g)

    def cost(state, x):
        ps = [1 / (1 + math.exp(-(0.1 - d + 0.7 * sum(p for s2, i, _, p, _, _ in rows if s2 == s and i in state)))) for s, i2, d, _, _, _ in rows if i2 == x]
        return 60 + (1 - np.mean(ps)) * 300 + 0.5 * np.var(ps, ddof=1)

    for e in (score, planner.Estimator(score.score)):
        for row in planner.dp_plans(plans, g, e, risk=0.5).collect():
            want = brute_plan(range(n), pairs, {row.plan_id}, cost)
            assert abs(row.total_cost - want[0]) < 1e-6 and row.path == want[1]


def test_large_graph(spark):
    """200 nodes, four words of state: narrow prerequisites, chains and a goal behind a cycle."""
    pairs = [(i, i + 40) for i in range(160)] + [(7, 199), (198, 191), (191, 198)]
    edges = edges_of(spark, pairs)
    nodes = graph.nodes(None, edges)
    g = planner.prepare(nodes, edges)
    table = nodes.select("idx", (0.5 + F.col("idx") / 1000).alias("p"), F.lit(0.0).alias("var"), F.lit(60.0).alias("t_base"))
    plans = planner.plans_for(spark.createDataFrame([(199,), (170,), (191,)], "node_id long"), g)
    got = {r.plan_id: (round(r.total_cost, 6), r.path) for r in planner.dp_plans(plans, g, planner.frequency_estimator(table)).collect()}
    cost = lambda path: round(sum(60 + (0.5 - x / 1000) * 300 for x in path), 6)
    a, b = [7, 39, 79, 119, 159, 199], [10, 50, 90, 130, 170]
    assert got == {199: (cost(a), a), 170: (cost(b), b), 191: (math.inf, [])}
    # a detour that pays: mastering 0 first makes each step of 170's chain cost 50 instead of 150; the bound keeps other detours out
    base = F.when(F.col("idx") == 0, 50.0).when(F.col("idx").isin(b), F.when(has_bit(F.col("state"), F.lit(0)), 50.0).otherwise(150.0)).otherwise(400.0)
    best = nodes.select("idx", F.lit(1.0).alias("p"), F.when(F.col("idx").isin([0, *b]), 50.0).otherwise(400.0).alias("t_base"))
    score = planner.Estimator(certain(base).score, best=best)
    got = planner.dp_plans(plans.where("plan_id = 170"), g, score).first()
    assert (got.total_cost, got.path) == (300.0, [0, *b])
    assert planner.greedy_plans(plans.where("plan_id = 170"), g, score).first().path[:3] == [0, 10, 50]


def test_unreachable(spark):
    nodes, edges = graph.nodes(None, edges_of(spark, LOOP)), edges_of(spark, LOOP)
    g = planner.prepare(nodes, edges)
    plans = planner.plans_for(spark.createDataFrame([(2,)], "node_id long"), g)
    for solve in (planner.dp_plans, planner.greedy_plans):
        got = solve(plans, g, certain(F.lit(1.0))).first()
        assert got.total_cost == math.inf and got.path == []


def test_components_and_cycles(spark):
    r = random.Random(4)
    for n, m in ((12, 16), (25, 30)):
        pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
        reach = {a: {b for x, b in pairs if x == a} for a in range(n)}
        for _ in range(n):
            reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
        root = {a: min(b for b in reach[a] if a in reach[b]) for a in range(n) if a in reach[a]}
        edges = edges_of(spark, sorted(pairs))
        assert {(x.node_id, x.root) for x in graph.components(edges).collect()} == set(root.items())
        want = []
        for first in sorted(set(root.values())):
            paths = [[first]]
            while not any((p[-1], first) in pairs for p in paths):
                paths = [p + [b] for p in paths for a, b in sorted(pairs) if a == p[-1] and root.get(b) == first and b not in p]
            want.append(min(p for p in paths if (p[-1], first) in pairs))
        assert sorted(x.cycle for x in graph.cycles(edges, None).collect()) == want
        assert sorted(x.cycle for x in graph.cycles(edges, 1).collect()) == want[:1]
    with pytest.raises(ValueError, match=r"\[0, 1, 2\]"):
        graph.check_dag(edges_of(spark, [*LOOP, (5, 0)]))


def test_numbered(spark):
    r = random.Random(1)
    rows = [(r.choice([None, *range(5)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(3)
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [tuple(x)[:2] for x in sorted(numbered(df, "n", "a", "b").collect(), key=lambda x: x.n)] == want
    assert sorted(x.n for x in numbered(df, "n", "a", "b").collect()) == list(range(300))
    assert numbered(df.limit(0), "n", "a").count() == 0


def dense_forward(wt, a, x, target, mask, d1=1.0, d2=1.0):
    """The model on whole matrices: x [B, N, 2], target [B], mask [B, N]."""
    h = (wt["emb"][None] + x @ wt["proj"] + wt["proj_b"]) * d1
    z = np.maximum(a @ (h @ wt["gcn"]) + wt["gcn_b"], 0) * d2
    pooled = (z * x[:, :, 1:2]).sum(axis=1) / np.maximum(x[:, :, 0].sum(axis=1), 1.0)[:, None]
    strength = (np.logaddexp(0, z) * mask[:, :, None]).sum(axis=1).mean(axis=1)
    gap = pooled @ wt["able"] + wt["able_b"] - z[np.arange(len(z)), target] @ wt["diff"] - wt["diff_b"] + np.abs(wt["w"][0]) * strength
    return 1 / (1 + np.exp(-gap))


@pytest.fixture(scope="module")
def learned(spark):
    """A graph of nine nodes, 60 samples with histories, a model, and the same as matrices."""
    r = random.Random(6)
    pairs = [(a, b) for a in range(9) for b in range(a + 1, 9) if r.random() < 0.3]
    edges = edges_of(spark, pairs)
    nodes = graph.nodes(spark.range(9).select(F.col("id").alias("node_id")), edges).cache()
    rows = [(u, s, [(i, r.random()) for i in sorted(r.sample(range(9), r.randrange(7)))], r.choice([None, *range(9)]) if s == 3 else r.randrange(9), r.random()) for u in range(12) for s in range(5)]
    data = spark.createDataFrame(rows, f"user_id long, session_id long, features {monotone.FEATURES}, target_idx long, label double").cache()
    norm = graph.normalized(nodes, edges).cache()
    a = np.zeros((9, 9))
    for e in norm.collect():
        a[e.src, e.dst] = e.weight
    x = np.zeros((len(rows), 9, 2))
    for k, row in enumerate(rows):
        for i, v in row[2]:
            x[k, i] = 1, v
    return nodes, norm, data, rows, a, x, monotone.init(9, hidden=6, seed=1)


def test_forward(spark, learned):
    nodes, norm, data, rows, a, x, wt = learned
    links = monotone.links(nodes, norm)
    ok = [k for k, row in enumerate(rows) if row[3] is not None]
    target = np.array([rows[k][3] for k in ok])
    want = dense_forward(wt, a, x[ok], target, x[ok][:, :, 0])
    got = {(r.user_id, r.session_id): r.p for r in monotone.predict(data, wt, links).collect()}
    assert np.allclose([got[rows[k][:2]] for k in ok], want, atol=1e-12) and all(got[row[:2]] is None for row in rows if row[3] is None) and len(ok) < len(rows)
    features = data.select("user_id", "session_id", F.explode("features").alias("f")).select("user_id", "session_id", "f.idx", "f.score")
    for passes, dropout in ((1, 0.0), (3, 0.4)):
        joined = monotone.joined_forward(data.select("user_id", "session_id", "target_idx"), features, nodes, monotone.indexed(nodes, norm), wt, passes=passes, dropout=dropout).collect()
        for at in range(passes):
            d1, d2 = (monotone.masks(at, np.arange(9), 6, k, dropout) for k in (0, 1))
            want = dense_forward(wt, a, x[ok], target, x[ok][:, :, 0], d1, d2)
            got = {(r.user_id, r.session_id): r.p for r in joined if r["pass"] == at}
            assert len(got) == len(ok) and np.allclose([got[rows[k][:2]] for k in ok], want, atol=1e-12)


def test_monte_carlo(spark, learned):
    """20 passes over samples with histories: mean and sample variance of the same draws on whole matrices."""
    nodes, norm, data, rows, a, x, wt = learned
    ok = [k for k, row in enumerate(rows) if row[3] is not None]
    target = np.array([rows[k][3] for k in ok])
    ps = [dense_forward(wt, a, x[ok], target, x[ok][:, :, 0], *(monotone.masks(at, np.arange(9), 6, k, 0.3) for k in (0, 1))) for at in range(20)]
    got = {(r.user_id, r.session_id): r for r in monotone.predict_mc(data, wt, monotone.links(nodes, norm)).collect()}
    assert np.allclose([got[rows[k][:2]].p for k in ok], np.mean(ps, axis=0)) and np.allclose([got[rows[k][:2]]["var"] for k in ok], np.var(ps, axis=0, ddof=1))
    assert np.mean([got[rows[k][:2]]["var"] for k in ok]) > 1e-5
    u = monotone.uniform(3, np.arange(2000), 16, 1)
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(u[:-1, 0], u[1:, 0])[0, 1]) < 0.06


def test_gradient(learned):
    nodes, norm, _, rows, _, _, wt = learned
    wt = {k: v.copy() for k, v in wt.items()}
    some = [row for row in rows if row[3] is not None][:7]
    s = monotone.Sparse(monotone.links(nodes, norm), [[{"idx": i, "score": v} for i, v in row[2]] for row in some], np.array([row[3] for row in some]))
    y, drop = np.array([row[4] for row in some]), monotone.drawn(wt, s, 2, 0.3)
    loss, g = monotone.gradient(wt, s, y, drop)
    for k, v in wt.items():
        for at in {tuple(0 for _ in v.shape), tuple(n - 1 for n in v.shape)}:
            v[at] += 1e-6
            up = monotone.gradient(wt, s, y, drop)[0]
            v[at] -= 1e-6
            assert abs((up - loss) / 1e-6 - g[k][at]) < 1e-3, k


def test_training_against_one_process(spark, learned):
    """Three epochs in exact batches: losses and weights of the same steps on whole matrices, with gradients by differences of the dense model."""
    nodes, norm, data, rows, a, x, wt = learned
    links, losses_of = monotone.links(nodes, norm), []
    falls = []
    trained, losses = monotone.train(data, wt, links, epochs=3, batch_size=20, rate=0.02, dropout=0.0, seed=5, after_epoch=lambda e, w: falls.append(e))
    where = {row[:2]: k for k, row in enumerate(rows)}
    now, adam = {k: v.copy() for k, v in wt.items()}, monotone.Adam(wt, 0.02)
    valid = data.where("target_idx is not null")
    for epoch in range(3):
        dealt = {}
        for r in sessions.batches(valid, 20, 5 + epoch).collect():
            dealt.setdefault(r.batch, []).append(where[r.user_id, r.session_id])
        assert [len(dealt[b]) for b in sorted(dealt)][:-1] == [20] * (len(dealt) - 1)
        batch = []
        for b in sorted(dealt):
            at = dealt[b]
            target, y = np.array([rows[k][3] for k in at]), np.array([rows[k][4] for k in at])
            error = lambda w: ((dense_forward(w, a, x[at], target, x[at][:, :, 0]) - y) ** 2).mean()  # noqa: E731,B023
            batch.append(error(now))
            g = {}
            for k, v in now.items():
                g[k] = np.zeros_like(v)
                for i in np.ndindex(*v.shape):
                    v[i] += 1e-6
                    up = error(now)
                    v[i] -= 2e-6
                    g[k][i] = (up - error(now)) / 2e-6
                    v[i] += 1e-6
            now = adam.moved(now, monotone.flat(g))
        losses_of.append(np.mean(batch))
    assert np.allclose(losses, losses_of, atol=1e-5) and losses[-1] < losses[0] and falls == [0, 1, 2]
    assert np.allclose(monotone.flat(trained), monotone.flat(now), atol=2e-3)


def test_batch_in_many_tasks(spark):
    """A large batch lies in as many files as there are cores, many small ones share folders, and none loses a row."""
    rows = spark.range(60_000).select(F.lit(1).alias("user_id"), F.col("id").alias("session_id"))
    for size, least in ((30_000, 4), (100, 1)):
        dealt, shards = monotone.shared_out(rows.withColumn("batch", F.floor(F.col("session_id") / size)), 60_000, size, 5000)
        n = -(-60_000 // size)
        found = dealt.withColumn("file", F.input_file_name()).groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.min("shard").alias("a"), F.max("shard").alias("b")).collect()
        assert len(found) == n and shards == min(n, 4)
        assert all(r.n == size and r.files >= least and r.a == r.b == r.batch * shards // n for r in found)


def test_nodes_drawn_once(learned, monkeypatch):
    """The dropouts of a batch are drawn for its nodes, not for its rows."""
    nodes, norm, _, _, _, _, wt = learned
    s, drawn, mask = monotone.Sparse(monotone.links(nodes, norm), [[{"idx": 1, "score": 0.5}]] * 500, np.full(500, 2)), [], monotone.masks
    monkeypatch.setattr(monotone, "masks", lambda at, idx, *a: drawn.append(len(idx)) or mask(at, idx, *a))
    d1, d2 = monotone.drawn(wt, s, 1, 0.3)
    assert max(drawn) <= 9 and (d1 == mask(1, s.part_node, 6, 0, 0.3)).all() and (d2 == mask(1, s.row_node, 6, 1, 0.3)).all()


def test_checkpoint(spark, learned, tmp_path):
    nodes, norm, data, _, _, _, wt = learned
    monotone.save_model(str(tmp_path / "m"), wt, nodes, dropout=0.3)
    back, index, config = monotone.load_model(spark, str(tmp_path / "m"))
    assert all(np.array_equal(back[k], wt[k]) for k in wt) and config == {"hidden": 6, "n_nodes": 9, "dropout": 0.3} and index.count() == 9
    monotone.save_model(str(tmp_path / "n"), wt, nodes.limit(3))
    with pytest.raises(ValueError, match="do not fit"):
        monotone.load_model(spark, str(tmp_path / "n"))


def test_terms_and_planner(spark, learned):
    """The planners' table says the same as the forward pass without features; more mastered never lowers a chance."""
    nodes, norm, _, _, a, _, wt = learned
    edges = monotone.indexed(nodes, norm)
    table = monotone.terms(nodes, edges, wt, passes=2, dropout=0.3)
    states = [0, 1, 0b10110, 0b111111111]
    asked = spark.createDataFrame([([s], i) for s in states for i in range(9)], "state array<bigint>, idx long")
    got = {(r.state[0], r.idx): r for r in monotone.estimator(table).score(asked).collect()}
    for s in states:
        mask = np.array([[float(s >> i & 1) for i in range(9)]])
        for i in range(9):
            ps = [dense_forward(wt, a, np.zeros((1, 9, 2)), np.array([i]), mask, *(monotone.masks(at, np.arange(9), 6, k, 0.3) for k in (0, 1)))[0] for at in range(2)]
            assert abs(got[s, i].p - np.mean(ps)) < 1e-12 and abs(got[s, i]["var"] - np.var(ps, ddof=1)) < 1e-12
    assert monotone.estimator(table.where("pass = 0")).score(asked).where("var <> 0").count() == 0
    pairs = spark.createDataFrame([(i, [s], [s | t]) for i in range(9) for s in (0, 5, 40) for t in (1, 64, 511)], "idx long, state array<bigint>, more array<bigint>")
    assert tuple(monotone.falls(pairs, wt, nodes, edges).first()) == (81, 0)
    worse = pairs.select("idx", F.col("more").alias("state"), F.col("state").alias("more"))
    assert monotone.falls(worse, wt, nodes, edges).first().n_falls > 0
