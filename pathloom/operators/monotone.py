"""The monotone estimator: a graph convolution whose success probability never falls when more is mastered.

With node states z = relu(A (h W) + b), h = embedding + projected features, the gap of a target t is
    ability(sum of z * score / seen) - difficulty(z_t) + |w| * mean over dims of the sum over mastered v of softplus(z_v),
and p is its sigmoid. Only the states of the target and of the nodes in the history matter, so a sample needs these nodes and their successors in the graph,
never all nodes: ``Sparse`` lays a batch of samples out as flat arrays of such (sample, node) rows. ``joined_forward`` says the same as joins and sums of
arrays. Dropout masks are a hash of (pass, node, dim), the same for all samples of a pass.

Planners ask with no features; then z depends on the weights and the draw only, and ``terms`` turns the model into a table (pass, idx, diff, pre) from
which any (state, node) is scored by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.scalars import bits_of, sigmoid, softplus
from pathloom.functions.store import saved, scratch_path, sized
from pathloom.operators.planner import Estimator
from pathloom.operators.sessions import batches

Weights = dict[str, np.ndarray]
FEATURES = "array<struct<idx: bigint, score: double>>"
#: Numbers in a row of gradients.
GRAIN = 4096


def init(n_nodes: int, hidden: int = 64, seed: int = 42) -> Weights:
    r = np.random.default_rng(seed)
    u = lambda bound, *shape: r.uniform(-bound, bound, shape)
    s, h = 1 / np.sqrt(2), 1 / np.sqrt(hidden)
    return {"emb": r.normal(0, 1, (n_nodes, hidden)), "proj": u(s, 2, hidden), "proj_b": u(s, hidden), "gcn": u(np.sqrt(3) * h, hidden, hidden), "gcn_b": np.zeros(hidden), "diff": u(h, hidden), "diff_b": u(h, 1), "able": u(h, hidden), "able_b": u(h, 1), "w": np.ones(1)}


PRIME = 2_147_483_647


def uniform(at: int, idx: np.ndarray, hidden: int, which: int) -> np.ndarray:
    """Numbers in [0, 1) for (pass, node, dim, dropout), [nodes, hidden]: three rounds of a quadratic map modulo a prime, which SQL can do too."""
    h = (np.asarray(idx, np.int64)[:, None] * 1_000_003 + np.arange(hidden) * 10_007 + at * 7_919 + which * 104_729 + 1) % PRIME
    for _ in range(3):
        h = (h * h + 374_761 * h + 668_265) % PRIME
    return h / PRIME


def masks(at: int, idx: np.ndarray, hidden: int, which: int, dropout: float) -> np.ndarray | float:
    return (uniform(at, idx, hidden, which) >= dropout) / (1 - dropout) if dropout else 1.0


@dataclass(frozen=True)
class Links:
    """The normalized adjacency: the successors of node v are ``to[start[v]:start[v + 1]]``, itself among them."""

    start: np.ndarray
    to: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, edges: list[tuple[int, int, float]], n: int) -> Links:
        src, dst, w = (np.array(x) for x in zip(*sorted(edges)))
        return cls(np.searchsorted(src, np.arange(n + 1)), dst.astype(np.int64), w.astype(float))


def links(nodes: DataFrame, normalized: DataFrame) -> Links:
    """The links on the driver: a row for each edge, as the model has a row for each node."""
    idx = nodes.select("node_id", "idx")
    rows = normalized.join(idx.select(F.col("node_id").alias("src"), F.col("idx").alias("a")), "src").join(idx.select(F.col("node_id").alias("dst"), F.col("idx").alias("b")), "dst")
    return Links.of([(r.a, r.b, r.weight) for r in rows.select("a", "b", "weight").collect()], nodes.count())


class Sparse:
    """Samples (arrays of idx and score, target) as flat rows: R for the nodes whose states count, Q for the nodes these are made of."""

    def __init__(self, links: Links, features: list | pa.ListArray, targets: np.ndarray):
        n = len(links.start) - 1
        if not isinstance(features, pa.Array):
            features = pa.array(features, pa.list_(pa.struct({"idx": pa.int64(), "score": pa.float64()})))
        size, entries = pc.list_value_length(features).to_numpy(zero_copy_only=False).astype(np.int64), features.flatten()
        idx, score = (entries.field(k).to_numpy(zero_copy_only=False) for k in ("idx", "score"))
        owner = np.repeat(np.arange(len(features)), size)
        self.n_samples, self.seen = len(features), np.maximum(size, 1).astype(float)
        held = owner * n + idx
        order = np.argsort(held)
        held, score = held[order], score[order]
        self.rows = np.unique(np.concatenate([held, np.arange(len(features)) * n + targets]))
        self.row_owner = self.rows // n
        self.target = np.searchsorted(self.rows, np.arange(len(features)) * n + targets)
        self.held = np.searchsorted(self.rows, held)  # rows of nodes in the history
        self.score, self.held_owner = score, held // n
        node = self.rows % n
        self.row_node = node
        count = links.start[node + 1] - links.start[node]
        self.pair_row = np.repeat(np.arange(len(node)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + links.start[node][self.pair_row]
        parts = self.row_owner[self.pair_row] * n + links.to[at]
        self.weight = links.weight[at][:, None]
        made, self.pair_part = np.unique(parts, return_inverse=True)
        self.part_node = made % n
        self.part_nodes, self.row_nodes = (np.unique(x, return_inverse=True) for x in (self.part_node, self.row_node))
        where = np.minimum(np.searchsorted(held, made), max(len(held) - 1, 0))
        known = (held[where] == made) if len(held) else np.zeros(len(made), bool)
        self.x = np.stack([known.astype(float), np.where(known, score[where], 0.0) if len(held) else np.zeros(len(made))], axis=1)


def summed(values: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` with equal ``by``, one dimension after the other."""
    if values.ndim == 1:
        return np.bincount(by, values, n)
    return np.stack([np.bincount(by, values[:, k], n) for k in range(values.shape[1])], axis=1)


def forward(wt: Weights, s: Sparse, drop: tuple | None = None) -> tuple[np.ndarray, dict]:
    """p of each sample; drop: multipliers of the two dropouts, for the Q and the R rows."""
    d1, d2 = drop if drop is not None else (1.0, 1.0)
    h = (wt["emb"][s.part_node] + s.x @ wt["proj"] + wt["proj_b"]) * d1
    raw = summed(s.weight * (h @ wt["gcn"])[s.pair_part], s.pair_row, len(s.rows)) + wt["gcn_b"]
    z = np.maximum(raw, 0) * d2
    zt, zh = z[s.target], z[s.held]
    pooled = summed(zh * s.score[:, None], s.held_owner, s.n_samples) / s.seen[:, None]
    strength = summed((np.log1p(np.exp(-zh)) + zh).mean(axis=1), s.held_owner, s.n_samples)  # states are never negative
    gap = pooled @ wt["able"] + wt["able_b"] - zt @ wt["diff"] - wt["diff_b"] + np.abs(wt["w"][0]) * strength
    return 1 / (1 + np.exp(-gap)), {"h": h, "raw": raw, "z": z, "zh": zh, "zt": zt, "pooled": pooled, "strength": strength, "d1": d1, "d2": d2}


def gradient(wt: Weights, s: Sparse, y: np.ndarray, drop: tuple | None = None) -> tuple[float, Weights]:
    """Sum of squared errors and its gradient."""
    p, c = forward(wt, s, drop)
    dgap = 2 * (p - y) * p * (1 - p)
    w, hidden = np.abs(wt["w"][0]), wt["emb"].shape[1]
    g = {"able": c["pooled"].T @ dgap, "able_b": np.array([dgap.sum()]), "diff": -c["zt"].T @ dgap, "diff_b": np.array([-dgap.sum()]), "w": np.array([np.sign(wt["w"][0]) * (dgap * c["strength"]).sum()])}
    own = dgap[s.held_owner][:, None]
    dz = summed(own * (s.score / s.seen[s.held_owner])[:, None] * wt["able"] + own * w / hidden / (1 + np.exp(-c["zh"])), s.held, len(s.rows))
    dz[s.target] -= dgap[:, None] * wt["diff"]
    draw = dz * c["d2"] * (c["raw"] > 0)
    g["gcn_b"] = draw.sum(axis=0)
    dm = summed(s.weight * draw[s.pair_row], s.pair_part, len(s.part_node))
    g["gcn"] = c["h"].T @ dm
    dh = (dm @ wt["gcn"].T) * c["d1"]
    g["emb"], g["proj_b"], g["proj"] = summed(dh, s.part_node, len(wt["emb"])), dh.sum(axis=0), s.x.T @ dh
    return float(((p - y) ** 2).sum()), g


def drawn(wt: Weights, s: Sparse, at: int, dropout: float) -> tuple:
    """The two dropouts' multipliers of pass ``at`` for a batch's rows; each node of the batch is drawn once."""
    hidden = wt["emb"].shape[1]
    if not dropout:
        return 1.0, 1.0
    return tuple(masks(at, node, hidden, which, dropout)[place] for which, (node, place) in enumerate((s.part_nodes, s.row_nodes)))


def predict_mc(data: DataFrame, wt: Weights, links: Links, *, passes: int = 20, dropout: float = 0.3) -> DataFrame:
    """data (features, target_idx and other columns) with p and var: mean and sample variance over the passes (null for one); a null target has null.

    Samples stay where they are: each Arrow batch is scored for all passes, and only mean and variance leave the task.
    """
    held = data.sparkSession.sparkContext.broadcast((wt, links))  # the model

    @F.arrow_udf("struct<p: double, var: double>")
    def chances(features: pa.Array, targets: pa.Array) -> pa.Array:
        wt, links = held.value
        ok = np.flatnonzero(targets.is_valid().to_numpy(zero_copy_only=False))
        p, var = np.full(len(targets), np.nan), np.full(len(targets), np.nan)
        if len(ok):
            s = Sparse(links, features.take(pa.array(ok)), targets.drop_null().to_numpy())
            ps = np.stack([forward(wt, s, drawn(wt, s, at, dropout))[0] for at in range(passes)])
            p[ok] = ps.mean(axis=0)
            if passes > 1:
                var[ok] = ps.var(axis=0, ddof=1)
        none = targets.is_null().to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(p, mask=none), pa.array(var, mask=none | (passes < 2))], ["p", "var"])

    asked = data.withColumn("_said", chances(F.coalesce("features", F.array().cast(FEATURES)), "target_idx"))
    return asked.withColumns({"p": F.col("_said.p"), "var": F.col("_said.var")}).drop("_said")


def predict(data: DataFrame, wt: Weights, links: Links) -> DataFrame:
    """data with p, without dropout."""
    return predict_mc(data, wt, links, passes=1, dropout=0.0).drop("var")


def vector_sum(vector: Column, hidden: int) -> Column:
    """The sum of arrays, dimension by dimension; partial sums are arrays too."""
    return F.array(*[F.sum(F.get(vector, F.lit(i))) for i in range(hidden)])


def messages(nodes: DataFrame, wt: Weights, passes: int, dropout: float) -> DataFrame:
    """pass, idx, m, s0, s1, d2: what a node sends without features, for being seen and for its score, and the second dropout of its state."""
    hidden = wt["emb"].shape[1]
    held = nodes.sparkSession.sparkContext.broadcast(wt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            idx, wt = b["idx"].to_numpy(np.int64), held.value
            for at in range(passes):
                d1, d2 = (np.broadcast_to(masks(at, idx, hidden, k, dropout), (len(idx), hidden)) for k in (0, 1))
                sent = [list((v * d1) @ wt["gcn"]) for v in (wt["emb"][idx] + wt["proj_b"], wt["proj"][0], wt["proj"][1])]
                yield pd.DataFrame({"pass": at, "idx": idx, "m": sent[0], "s0": sent[1], "s1": sent[2], "d2": list(d2)})

    v = "array<double>"
    return nodes.select("idx").mapInPandas(run, f"pass int, idx long, m {v}, s0 {v}, s1 {v}, d2 {v}")


def indexed(nodes: DataFrame, normalized: DataFrame) -> DataFrame:
    """v, u, weight: the normalized edges by idx."""
    a, b = (nodes.select(F.col("node_id").alias(x), F.col("idx").alias(y)) for x, y in (("src", "v"), ("dst", "u")))
    return normalized.join(a, "src").join(b, "dst").select("v", "u", "weight")


def times(vector: Column, by: Column) -> Column:
    return F.transform(vector, lambda x: x * by)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def base_states(edges: DataFrame, sent: DataFrame, hidden: int) -> DataFrame:
    """pass, v, base: the sum of what the successors send, before bias and relu: a join of edges with messages and one aggregation."""
    rows = edges.join(sent, edges["u"] == sent["idx"]).select("pass", "v", times(F.col("m"), F.col("weight")).alias("x"))
    return rows.groupBy("pass", "v").agg(vector_sum(F.col("x"), hidden).alias("base"))


def activated(raw: Column, bias: np.ndarray, d2: Column) -> Column:
    return F.zip_with(plus(raw, F.array(*map(F.lit, bias.tolist()))), d2, lambda x, d: F.greatest(x, F.lit(0.0)) * d)


def dot(vector: Column, weights: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, weights.tolist())), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)


def mean_softplus(z: Column, hidden: int) -> Column:
    return F.aggregate(F.transform(z, softplus), F.lit(0.0), lambda a, x: a + x) / hidden


def joined_forward(samples: DataFrame, features: DataFrame, nodes: DataFrame, edges: DataFrame, wt: Weights, *, passes: int = 1, dropout: float = 0.0) -> DataFrame:
    """user_id, session_id, pass, p for samples (user_id, session_id, target_idx) and features (user_id, session_id, idx, score), by joins and sums.

    ``edges`` has v, u, weight. A sample's rows are its target, the nodes of its history, and those among these that are linked; nothing is as long as the graph.
    """
    hidden, key = wt["emb"].shape[1], ["user_id", "session_id"]
    sent = saved(messages(nodes, wt, passes, dropout), "messages")
    base = base_states(edges, sent, hidden).join(sent.select("pass", F.col("idx").alias("v"), "d2"), ["pass", "v"])
    base = sized(saved(base, "base"))
    asked = samples.where("target_idx is not null").select(*key, F.col("target_idx").alias("v"), F.lit(True).alias("target"), F.lit(None).cast("double").alias("score"))
    rows = asked.union(features.select(*key, "idx", F.lit(False), "score")).groupBy(*key, "v").agg(F.max("target").alias("target"), F.max("score").alias("score"))
    rows = saved(rows, "rows")
    near = rows.select(*key, "v").join(edges, "v").join(features.select(*key, F.col("idx").alias("u"), F.col("score").alias("s")), [*key, "u"])
    near = near.join(sized(sent.select("pass", F.col("idx").alias("u"), "s0", "s1")), "u")
    moved = near.select(*key, "v", "pass", times(plus(F.col("s0"), times(F.col("s1"), F.col("s"))), F.col("weight")).alias("x")).groupBy(*key, "v", "pass").agg(vector_sum(F.col("x"), hidden).alias("moved"))
    raw = F.when(F.col("moved").isNull(), F.col("base")).otherwise(plus(F.col("base"), F.col("moved")))
    states = rows.join(base, "v").join(moved, [*key, "v", "pass"], "left").withColumn("z", activated(raw, wt["gcn_b"], F.col("d2")))
    seen = F.col("score").isNotNull()
    terms = states.groupBy(*key, "pass").agg(
        F.max(F.when(F.col("target"), dot(F.col("z"), wt["diff"]))).alias("diff"),
        F.coalesce(F.sum(F.when(seen, dot(F.col("z"), wt["able"]) * F.col("score"))), F.lit(0.0)).alias("able"),
        F.coalesce(F.sum(F.when(seen, mean_softplus(F.col("z"), hidden))), F.lit(0.0)).alias("strength"),
        F.greatest(F.count_if(seen), F.lit(1)).alias("seen"),
    )
    gap = F.col("able") / F.col("seen") + float(wt["able_b"][0]) - F.col("diff") - float(wt["diff_b"][0]) + abs(float(wt["w"][0])) * F.col("strength")
    return terms.where("diff is not null").select(*key, "pass", sigmoid(gap).alias("p"))


def terms(nodes: DataFrame, edges: DataFrame, wt: Weights, *, passes: int = 20, dropout: float = 0.3) -> DataFrame:
    """pass, idx, diff, pre, able, w: passes x nodes rows, one dropout draw for each pass."""
    hidden = wt["emb"].shape[1]
    sent = saved(messages(nodes, wt, passes, dropout), "messages")
    rows = base_states(edges, sent, hidden).join(sent.select("pass", F.col("idx").alias("v"), "d2"), ["pass", "v"]).withColumn("z", activated(F.col("base"), wt["gcn_b"], F.col("d2")))
    made = rows.select("pass", F.col("v").alias("idx"), (dot(F.col("z"), wt["diff"]) + float(wt["diff_b"][0])).alias("diff"), mean_softplus(F.col("z"), hidden).alias("pre"))
    return saved(made.withColumn("able", F.lit(float(wt["able_b"][0]))).withColumn("w", F.lit(abs(float(wt["w"][0])))), "terms")


def estimator(table: DataFrame, t_base: float = 60.0) -> Estimator:
    """Scores of (state, idx) rows from the terms: mean and sample variance of p over the passes (0 for a single pass). The best chance is with all mastered."""
    side = sized(table)  # passes x nodes rows

    def score(steps: DataFrame) -> DataFrame:
        asked = steps.select("state", "idx").distinct()
        held = asked.select("state").distinct().select("state", F.explode(bits_of(F.col("state"))).alias("idx")).join(side.select("pass", "idx", "pre"), "idx")
        held = held.groupBy("state", "pass").agg(F.sum("pre").alias("strength"))
        both = asked.join(side.select("pass", "idx", "diff", "able", "w"), "idx").join(held, ["state", "pass"], "left")
        both = both.select("state", "idx", sigmoid(F.col("able") - F.col("diff") + F.col("w") * F.coalesce("strength", F.lit(0.0))).alias("one"))
        scored = both.groupBy("state", "idx").agg(F.avg("one").alias("p"), F.coalesce(F.var_samp("one"), F.lit(0.0)).alias("var")).withColumn("t_base", F.lit(t_base))
        return steps.join(scored, ["state", "idx"])

    whole = table.groupBy("pass").agg(F.sum("pre").alias("strength"))
    best = table.join(whole, "pass").groupBy("idx").agg(F.avg(sigmoid(F.col("able") - F.col("diff") + F.col("w") * F.col("strength"))).alias("p"))
    return Estimator(score, best=best.withColumn("t_base", F.lit(t_base)))


def summed_gradients(made: DataFrame) -> dict[int, np.ndarray]:
    """at -> the sum of rows (at, values): in tasks first over some of the rows of a place, then over all; the driver gets one model."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.iloc[:1].copy()
        out["values"] = [np.sum(np.stack(rows["values"].to_list()), axis=0)]
        return out

    parts = made.withColumn("salt", (F.spark_partition_id() % 16).cast("int")).groupBy("at", "salt").applyInPandas(lambda r: add(r), "at int, values array<double>, salt int")
    return {r["at"]: np.array(r["values"]) for r in parts.groupBy("at").applyInPandas(lambda r: add(r), "at int, values array<double>, salt int").collect()}


def flat(g: Weights) -> np.ndarray:
    return np.concatenate([v.ravel() for v in g.values()])


class Adam:
    def __init__(self, wt: Weights, rate: float):
        self.rate, self.step = rate, 0
        self.first, self.second = np.zeros_like(flat(wt)), np.zeros_like(flat(wt))

    def moved(self, wt: Weights, g: np.ndarray) -> Weights:
        self.step += 1
        self.first += 0.1 * (g - self.first)
        self.second += 0.001 * (g * g - self.second)
        move = self.rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)
        out, at = {}, 0
        for k, v in wt.items():
            out[k] = v - move[at : at + v.size].reshape(v.shape)
            at += v.size
        return out


def shared_out(dealt: DataFrame, n_rows: int, size: int, least: int = 10_000) -> tuple[DataFrame, int]:
    """The rows with ``shard``, written in folders of some neighbouring batches each, and the number of shards; a shard of over ``least`` rows has files for all
    cores, so that all work on a batch, however large it is."""
    spark, n_batches = dealt.sparkSession, max(1, -(-n_rows // size))
    shards = min(n_batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = max(1, min(spark.sparkContext.defaultParallelism, -(-n_rows // (shards * least))))
    rows = dealt.withColumn("shard", F.expr(f"batch * {shards} div {n_batches}").cast("int"))
    salt = F.pmod(F.xxhash64("user_id", "session_id"), F.lit(files))
    path = scratch_path(spark, "batches")
    placed = rows.repartitionById(shards * files, (F.col("shard") * files + salt).cast("int"))
    placed.sortWithinPartitions("shard", "batch").write.partitionBy("shard").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), shards


def train(data: DataFrame, wt: Weights, links: Links, *, epochs: int = 50, batch_size: int = 32, rate: float = 1e-3, dropout: float = 0.3, seed: int = 42, after_epoch=None) -> tuple[Weights, list[float]]:
    """Adam on the mean squared error over exactly shuffled batches; the weights, and each epoch's mean of its batches' losses.

    ``data`` has user_id, session_id, features, target_idx, label. Tasks give gradients of their samples in rows of GRAIN numbers, which Spark sums.
    ``after_epoch(epoch, weights)`` is called after each epoch.
    """
    names = list(wt)
    wt, losses, adam, at = {k: v.copy() for k, v in wt.items()}, [], Adam(wt, rate), 0
    rows = data.where("target_idx is not null and label is not null").select("user_id", "session_id", F.coalesce("features", F.array().cast(FEATURES)).alias("features"), "target_idx", "label")
    n_rows = rows.count()
    for epoch in range(epochs):
        dealt, n_shards = shared_out(batches(rows, batch_size, seed + epoch), n_rows, batch_size)
        batch_losses, n_batches = [], -(-n_rows // batch_size)
        for batch in range(n_batches):

            def run(parts: Iterator[pa.RecordBatch], now=wt, at=at) -> Iterator[pa.RecordBatch]:
                total, loss, n = None, 0.0, 0
                for b in parts:
                    if len(b):
                        s = Sparse(links, b.column("features"), b.column("target_idx").to_numpy())
                        e, g = gradient(now, s, b.column("label").to_numpy(), drawn(now, s, at, dropout))
                        g = flat({k: g[k] for k in names})
                        total, loss, n = g if total is None else total + g, loss + e, n + len(b)
                if n:
                    total = np.concatenate([[loss, n], total])
                    starts = range(0, len(total), GRAIN)
                    yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[i : i + GRAIN] for i in starts], pa.list_(pa.float64()))], ["at", "values"])

            mine = dealt.where((F.col("shard") == batch * n_shards // n_batches) & (F.col("batch") == batch)).select("features", "target_idx", "label")
            got = summed_gradients(mine.mapInArrow(run, "at int, values array<double>"))
            whole = np.concatenate([got[i] for i in sorted(got)])
            loss, n, g = whole[0], whole[1], whole[2:]
            wt, at = adam.moved(wt, g / n), at + 1
            batch_losses.append(loss / n)
        losses.append(float(np.mean(batch_losses)) if batch_losses else 0.0)
        if after_epoch is not None:
            after_epoch(epoch, wt)
    return wt, losses


def falls(pairs: DataFrame, wt: Weights, nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """n_pairs, n_falls of rows (idx, state, more): how often a node's chance is less when the larger state ``more`` is mastered."""
    score = estimator(terms(nodes, edges, wt, passes=1, dropout=0.0)).score
    before = score(pairs.select("idx", "state", "more")).select("idx", "more", F.col("p").alias("before")).withColumnRenamed("more", "state")
    return score(before).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("p") + tolerance < F.col("before")).alias("n_falls"))


def weight_table(spark: SparkSession, wt: Weights) -> DataFrame:
    return spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in wt.items()], "name string, shape array<int>, data array<double>")


def from_table(df: DataFrame) -> Weights:
    return {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in df.collect()}


def save_model(path: str, wt: Weights, nodes: DataFrame, **config: float) -> None:
    """A checkpoint: weights, the nodes' idx, and settings."""
    spark = nodes.sparkSession
    weight_table(spark, wt).write.mode("overwrite").parquet(f"{path}/weights")
    nodes.select("node_id", "idx").write.mode("overwrite").parquet(f"{path}/index")
    settings = {"hidden": wt["emb"].shape[1], "n_nodes": len(wt["emb"])} | config
    spark.createDataFrame([(k, float(v)) for k, v in settings.items()], "name string, value double").write.mode("overwrite").parquet(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[Weights, DataFrame, dict[str, float]]:
    """Weights, nodes and settings of a checkpoint, which must fit each other."""
    wt, nodes = from_table(spark.read.parquet(f"{path}/weights")), spark.read.parquet(f"{path}/index")
    config = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/config").collect()}
    if nodes.count() != len(wt["emb"]) or config["hidden"] != wt["emb"].shape[1]:
        raise ValueError(f"{path}: weights of {wt['emb'].shape} do not fit {nodes.count()} nodes and hidden size {config['hidden']:g}")
    return wt, nodes, config
