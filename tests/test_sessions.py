import random

import pandas as pd
from pyspark.sql import functions as F

from pathloom.operators import frequency, graph, sessions
from pathloom.operators.checks import violations
from pathloom.sources import tables as src

#: user -> (session, node, mean, first time, items)
TOY_SESSIONS = {
    1: [(0, 0, 1.0, 1, 2), (1, 1, 0.5, 2, 2), (2, 2, 1.0, 3, 2), (3, 3, 0.0, 4, 1), (4, 0, 1.0, 5, 1)],
    2: [(0, 0, 0.5, 2, 2), (1, 1, 1.0, 4, 1), (2, 2, 0.5, 5, 2)],
    3: [(0, 0, 1.0, 1, 2), (1, 1, 1.0, 2, 2), (2, 2, 0.0, 3, 2), (3, 3, 0.5, 4, 2)],
}


def toy(spark):
    log, items = src.toy_log(spark), src.item_map(spark, toy=True)
    return sessions.sessions(sessions.with_nodes(log, items))


def test_toy_sessions(spark):
    got = {}
    for r in toy(spark).orderBy("user_id", "session_id").collect():
        got.setdefault(r.user_id, []).append((r.session_id, r.node_id, r.avg_score, r.timestamp, r.n_items))
    assert got == TOY_SESSIONS
    assert sessions.known_items(src.toy_log(spark), src.item_map(spark, toy=True)).count() == 21


def test_samples_and_few_shot(spark):
    sampled = sessions.samples(toy(spark))
    last = sampled.where("user_id = 1 and session_id = 4").first()
    assert [tuple(h) for h in last.history] == [(0, 1.0), (1, 0.5), (2, 1.0), (3, 0.0)] and last.target_node == 0 and last.label == 1.0
    assert sessions.few_shot(sampled, 2).groupBy("target_node").count().where("count > 2").count() == 0
    assert sessions.few_shot(sampled, None).count() == 12
    latest = sessions.latest_features(sampled.where("user_id = 1")).where("session_id = 4").collect()
    assert {r.node_id: r.latest_score for r in latest} == {0: 1.0, 1: 0.5, 2: 1.0, 3: 0.0}
    assert [r["order"] for r in sessions.ordered(src.toy_log(spark)).orderBy("user_id", "timestamp", "item_id", "row_id").collect()] == list(range(22))


def test_frequency(spark):
    nodes = graph.nodes(src.item_map(spark, toy=True), src.edge_list(spark, toy=True))
    got = {r.node_id: (round(r.p, 6), r.n) for r in frequency.fit(sessions.samples(toy(spark)), nodes).collect()}
    assert got == {0: (0.875, 4), 1: (0.833333, 3), 2: (0.5, 3), 3: (0.25, 2)}
    one = spark.createDataFrame([(0, 0.8), (1, 0.6), (2, 1.0)], "target_node long, label double")
    unseen = {r.node_id: round(r.p, 6) for r in frequency.fit(one, nodes).collect()}
    assert unseen[3] == 0.8


def test_empty_log(spark):
    empty = sessions.with_nodes(src.toy_log(spark).limit(0), src.item_map(spark, toy=True))
    found = sessions.sessions(empty)
    assert found.count() == 0 and sessions.samples(found).count() == 0


def test_quality(spark):
    f = toy(spark)
    nodes, edges = graph.nodes(None, src.edge_list(spark, toy=True)), src.edge_list(spark, toy=True)
    assert {r.n_violations for r in violations(f, sessions.samples(f), nodes, graph.on_cycles(edges)).collect()} == {0}
    bad = f.where("session_id <> 1")
    assert violations(bad, sessions.samples(bad), nodes.where("node_id <> 3"), edges).where("n_violations > 0").count() == 3


def test_sources(spark, tmp_path):
    import pytest

    src.write_toy_log(spark, str(tmp_path / "log"))
    back = src.read_log(spark, str(tmp_path / "log"))
    assert sorted(map(tuple, back.drop("row_id").collect())) == sorted(src.TOY_LOG)
    (tmp_path / "map.csv").write_text("item_id,node_id\n1,5\n2,6\n1,7\n")
    assert {r.item_id: r.node_id for r in src.item_map(spark, str(tmp_path / "map.csv")).collect()} == {1: 7, 2: 6}
    with pytest.raises(ValueError, match="node_id"):
        (tmp_path / "bad.csv").write_text("item_id\n1\n")
        src.item_map(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError):
        src.edge_list(spark)
    src.write_bundle(str(tmp_path / "graph"), edges=src.edge_list(spark, toy=True))
    assert src.read_bundle(spark, str(tmp_path / "graph"), "edges")[0].count() == 4


def test_config(tmp_path):
    from pathloom.sources.config import Config, load

    (tmp_path / "c.yaml").write_text("seed: 7\noracle:\n  lr: 0.01\n  epochs: 3\nplanner:\n  t_penalty: 10\nother: {x: 1}\n")
    assert load(str(tmp_path / "c.yaml")) == Config(seed=7, learning_rate=0.01, epochs=3, t_penalty=10)


def test_streaming(spark, tmp_path):
    """Sessions of a log that comes in parts, a late row, and the end of the stream."""
    from pathloom.streaming.sessions import STORE, closed_sessions

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows, hour = sessions.with_nodes(src.toy_log(spark), src.item_map(spark, toy=True)).cache(), 3_600_000
    of_user = lambda user, time: rows.limit(1).select(*[F.lit({"user_id": user, "timestamp": time}.get(c, 0)).cast(t).alias(c) for c, t in rows.dtypes])
    rows.limit(0).write.parquet(str(tmp_path / "in"))
    stream = closed_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), idle_ms=20 * hour, delay="10 hours")
    late = of_user(2, 1)  # user 2 has been read up to 4
    for part in (rows.where("timestamp <= 2"), rows.where("timestamp between 3 and 4"), late, rows.where("timestamp > 4"), of_user(-1, 1000)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.user_id, r.session_id, r.node_id, r.avg_score, r.timestamp, r.n_items) for r in got} == {(u, *s) for u, all_ in TOY_SESSIONS.items() for s in all_}
    assert [(r.user_id, r.session_id, r.n_late) for r in got if r.n_late] == [(2, 1, 1)]


def test_stream_takes_users_in_groups(spark, tmp_path):
    """All new users of a group are taken in one call, with one timer; null users and null nodes have sessions too."""
    from pathloom.streaming.sessions import STORE, advanced, closed_sessions

    r, hour = random.Random(5), 3_600_000
    log = [(u, i % 3, u is None or i % 2, 10 + 2 * i + part, 1000 * i + part, r.choice([1, 2, 2, None])) for part in (0, 1) for u in [*range(60), None] for i in range(4)]
    rows = spark.createDataFrame([(u, a, int(b), t, n, node) for u, a, b, t, n, node in log], "user_id long, item_id long, is_correct int, timestamp long, row_id long, node_id long").cache()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows.limit(0).write.parquet(str(tmp_path / "in"))
    stream = closed_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), idle_ms=20 * hour, groups=3)
    marker = rows.limit(1).select(*[F.lit({"user_id": -1, "timestamp": 1000}.get(c, 0)).cast(t).alias(c) for c, t in rows.dtypes])
    keys = []
    for part in (rows.where("timestamp < 14"), rows.where("timestamp >= 14"), marker):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        keys.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress))
    got = spark.read.parquet(str(tmp_path / "out")).drop("n_late")
    assert sorted(map(str, got.collect())) == sorted(map(str, sessions.sessions(rows).collect()))
    assert max(keys) <= 4 * 3  # of four groups a value, and a timer in two orders; not of each user
    held = pd.DataFrame({"user_id": [], "session_id": [], "node_id": [], "total": [], "n": [], "first": [], "last": [], "n_late": []}).astype("int64")
    closed, held = advanced(held, pd.DataFrame({"user_id": [1, 1, 2], "timestamp": [3, 4, 5], "item_id": 0, "row_id": 0, "node_id": [7, 8, 9], "is_correct": 1}))
    assert closed[["user_id", "node_id"]].values.tolist() == [[1, 7]] and held[["user_id", "node_id", "session_id"]].values.tolist() == [[1, 8, 1], [2, 9, 0]]


def test_features_in_a_stream(spark):
    """The features of the stream are those of the joins, whatever fits a step, for users over several batches, and for null users and unknown nodes."""
    r = random.Random(3)
    rows = [(u, s, r.randrange(6), r.choice([None, 0.0, 0.25, 1.0])) for u in (1, 2, 3, None) for s in range(30)]
    found = spark.createDataFrame(rows, "user_id long, session_id long, node_id long, avg_score double")
    nodes = spark.createDataFrame([(n, n + 10) for n in range(5)], "node_id long, idx long")
    want = {}
    for x in sessions.latest_scores(found).where("user_id is not null").join(nodes, "node_id").collect():
        want.setdefault((x.user_id, x.session_id), []).append((x.idx, x.latest_score))
    data = sessions.featured(found, nodes)
    got = {(x.user_id, x.session_id): [tuple(f) for f in x.features] for x in data.collect()}
    assert len(got) == len(rows) and got == {k: sorted(want.get(k, [])) for k in got}
    assert data.where("target_idx is null").count() == sum(n == 5 for _, _, n, _ in rows)
    flat = spark.createDataFrame([(u, s, n, n + 10 if n < 5 else None, v) for u, s, n, v in rows], "user_id long, session_id long, target_node long, target_idx long, label double")
    one = flat.repartition(1).sortWithinPartitions("user_id", "session_id").mapInArrow(lambda b: sessions.with_latest(b, 7), data.schema)
    assert {(x.user_id, x.session_id): [tuple(f) for f in x.features] for x in one.collect()} == got


def test_users_dealt_to_tasks(spark):
    """Sessions of a large log come from as many tasks as its rows ask for."""
    log, items = src.toy_log(spark), src.item_map(spark, toy=True)
    mapped = sessions.with_nodes(log, items)
    assert src.tasks_for(log, 2) == 11 and src.tasks_for(log) == spark.sparkContext.defaultParallelism
    dealt = sessions.sessions(mapped, 11)
    assert dealt.rdd.getNumPartitions() == 11 and sorted(map(tuple, dealt.collect())) == sorted(map(tuple, sessions.sessions(mapped).collect()))
