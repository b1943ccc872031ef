"""Learning-path planners over mastery states, as level-synchronous joins.

A state is an array of 64-bit words with a bit for each mastered node. All plans of a call (a start state and a goal of one or several nodes each) move
through the levels together. An ``Estimator`` adds p, var and t_base to rows with ``state`` and ``idx``.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.scalars import bits_of, collect_bits, contains, either, has_bit, n_words, no_bits, one_bit, step_cost
from pathloom.functions.store import saved, sized
from pathloom.operators.graph import frontier, reached

#: Bytes of the action table up to which it is broadcast.
MOST_BYTES = 64 << 20
#: Costs that differ by less are equal.
PLACES = 9


@dataclass(frozen=True)
class Estimator:
    """``score`` adds p, var, t_base. With ``state_free`` they depend on idx only. ``best`` (idx, p, t_base) has the largest chance and least base time of a
    node in any state, for bounds; without it a step may cost nothing."""

    score: Callable[[DataFrame], DataFrame]
    state_free: bool = False
    best: DataFrame | None = None


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    actions: DataFrame
    words: int
    small: bool


def prepare(nodes: DataFrame, edges: DataFrame, most_bytes: int = MOST_BYTES) -> Graph:
    """The graph with its action table: node_id, idx, needs (bits of the prerequisites), a row for each node."""
    nodes, edges = saved(nodes.select("node_id", "idx"), "nodes"), saved(edges.select("src", "dst").distinct(), "edges")
    n = nodes.count()
    words = n_words(n)
    idx = nodes.select(F.col("node_id").alias("src"), F.col("idx").alias("src_idx"))
    needs = edges.join(idx, "src").groupBy(F.col("dst").alias("node_id")).agg(collect_bits(F.col("src_idx"), words).alias("needs"))
    actions = saved(nodes.join(needs, "node_id", "left").select("node_id", "idx", F.coalesce("needs", no_bits(words)).alias("needs")), "actions")
    return Graph(nodes, edges, actions, words, n * (8 * words + 64) <= most_bytes)


def plans_for(targets: DataFrame, graph: Graph) -> DataFrame:
    """plan_id (the target), a state with nothing mastered, and the target's bit."""
    return targets.join(graph.nodes, "node_id").select(F.col("node_id").alias("plan_id"), no_bits(graph.words).alias("state"), one_bit(F.col("idx"), graph.words).alias("goal"))


def user_plans(mastered: DataFrame, goals: DataFrame, graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(user_id, plan_id) for users with goals, and (plan_id, state, goal): users with the same mastered nodes and the same goals share a plan.

    ``mastered`` and ``goals`` hold user_id, node_id; nodes outside the graph are passed over. Users without goals have no row.
    """

    def bits(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(graph.nodes, "node_id").groupBy("user_id").agg(collect_bits(F.col("idx"), graph.words).alias(name))

    each = bits(goals, "goal").join(bits(mastered, "state"), "user_id", "left").select("user_id", F.coalesce("state", no_bits(graph.words)).alias("state"), "goal")
    each = saved(each, "users")
    plans = saved(each.select("state", "goal").distinct().withColumn("plan_id", F.monotonically_increasing_id()), "plans")
    return each.join(plans, ["state", "goal"]).select("user_id", "plan_id"), plans.select("plan_id", "state", "goal")


def expand(states: DataFrame, graph: Graph) -> DataFrame:
    """Each state with each of its allowed next nodes (node_id, idx) and the ``next`` state.

    A theta join with the broadcast action table where that is small; else allowed nodes are found by joins of the states' nodes with the edges.
    """
    if graph.small:
        fits = ~has_bit(F.col("state"), F.col("idx")) & contains(F.col("state"), F.col("needs"))
        steps = states.join(F.broadcast(graph.actions), fits).drop("needs")
    else:
        asked = saved(states.select("state").distinct().withColumn("user_id", F.monotonically_increasing_id()), "asked")
        held = asked.select("user_id", F.explode(bits_of(F.col("state"))).alias("idx")).join(graph.nodes, "idx").select("user_id", "node_id")
        allowed = frontier(graph.nodes, graph.edges, held, asked, fallback=False).join(asked, "user_id").join(graph.nodes, "node_id")
        steps = states.join(allowed.select("state", "node_id", "idx"), "state")
    return steps.withColumn("next", either(F.col("state"), one_bit(F.col("idx"), graph.words)))


def costed(steps: DataFrame, estimator: Estimator, t_penalty: float, risk: float) -> DataFrame:
    return estimator.score(steps).withColumn("cost", step_cost(F.col("p"), F.col("var"), F.col("t_base"), t_penalty, risk))


def closures(plans: DataFrame, graph: Graph) -> DataFrame:
    """plan_id, node_id, idx: the goal's nodes that are not mastered, and what is needed for them."""
    lacking = lambda rows: rows.join(plans.select("plan_id", "state"), "plan_id").where(~has_bit(F.col("state"), F.col("idx"))).select("plan_id", "node_id", "idx")
    start = lacking(plans.select("plan_id", F.explode(bits_of(F.col("goal"))).alias("idx")).join(graph.nodes, "idx").select("plan_id", "node_id", "idx"))

    def needed(level: DataFrame) -> DataFrame:
        above = level.select("plan_id", F.col("node_id").alias("dst")).join(graph.edges, "dst").select("plan_id", F.col("src").alias("node_id")).distinct()
        return lacking(above.join(graph.nodes, "node_id"))

    return saved(reached(start, needed), "closures")


def in_order(closure: DataFrame, graph: Graph) -> DataFrame:
    """plan_id, path, whole: the closure's nodes, always the least that is allowed next; not whole where cycles stop it. A closure is a part of the graph."""
    inner = closure.select("plan_id", F.col("node_id").alias("src")).join(graph.edges, "src")
    needs = inner.groupBy("plan_id", F.col("dst").alias("node_id")).agg(F.collect_list("src").alias("needs"))
    rows = closure.join(needs, ["plan_id", "node_id"], "left").select("plan_id", "node_id", "needs")

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        needs = {n: set(x) if x is not None else set() for n, x in zip(rows["node_id"], rows["needs"])}
        after: dict[int, list[int]] = {}
        for n, xs in needs.items():
            for x in xs:
                after.setdefault(x, []).append(n)
        left, path, ready = {n: len(xs) for n, xs in needs.items()}, [], [n for n, xs in needs.items() if not xs]
        heapq.heapify(ready)
        while ready:
            n = heapq.heappop(ready)
            path.append(n)
            for m in after.get(n, ()):
                left[m] -= 1
                if not left[m]:
                    heapq.heappush(ready, m)
        return pd.DataFrame({"plan_id": rows["plan_id"].iloc[:1], "path": [path], "whole": [len(path) == len(needs)]})

    return rows.groupBy("plan_id").applyInPandas(order, "plan_id long, path array<bigint>, whole boolean")


def along(paths: DataFrame, plans: DataFrame, graph: Graph) -> DataFrame:
    """plan_id, pos, node_id, idx and the state before each step of paths (plan_id, path)."""
    steps = paths.select("plan_id", F.posexplode("path").alias("pos", "node_id")).join(graph.nodes, "node_id").join(plans.select("plan_id", F.col("state").alias("start")), "plan_id")
    before = Window.partitionBy("plan_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("state", either(F.col("start"), collect_bits(F.col("idx"), graph.words, before))).drop("start")


def _nothing() -> Column:
    return F.array().cast("array<bigint>")


def direct_plans(plans: DataFrame, graph: Graph, estimator: Estimator, *, t_penalty: float = 300.0, risk: float = 0.0, closure: DataFrame | None = None) -> DataFrame:
    """plan_id, total_cost, path through what the goal needs and nothing else; unreachable is (inf, []). Where steps cost something whatever the state, no plan is better."""
    closure = closures(plans, graph) if closure is None else closure
    paths = saved(in_order(closure, graph), "paths")
    priced = costed(along(paths.where("whole"), plans, graph), estimator, t_penalty, risk).groupBy("plan_id").agg(F.sum("cost").alias("total"))
    rows = plans.select("plan_id").join(paths, "plan_id", "left").join(priced, "plan_id", "left")
    cost = F.when(F.col("whole").isNull(), 0.0).when(F.col("whole"), F.col("total")).otherwise(float("inf"))
    return saved(rows.select("plan_id", cost.alias("total_cost"), F.when(F.col("whole"), F.col("path")).otherwise(_nothing()).alias("path")), "direct")


def dp_plans(plans: DataFrame, graph: Graph, estimator: Estimator, *, t_penalty: float = 300.0, risk: float = 0.0, closure: DataFrame | None = None) -> DataFrame:
    """plan_id, total_cost, path of least expected cost; ties go to the lexicographically least path, unreachable is (inf, []).

    A level holds the best (cost, path) of each state that a plan can reach in so many steps; costs are compared when rounded, so that sums in different
    orders tie. A state is given up when its cost and the least that the nodes still needed can cost are more than the direct plan's cost. For
    an estimator that does not look at the state the direct plan is the best. ``closure``: that of the plans, where it is known.
    """
    plans = saved(plans.select("plan_id", "state", "goal"), "plans")
    closure = closures(plans, graph) if closure is None else closure
    direct = direct_plans(plans, graph, estimator, t_penalty=t_penalty, risk=risk, closure=closure)
    if estimator.state_free:
        return direct
    best = estimator.best
    floor = F.lit(0.0) if best is None else F.greatest(step_cost(F.col("p"), F.lit(0.0), F.col("t_base"), t_penalty, 0.0), F.lit(0.0))
    floors = closure.select("plan_id", "idx", F.lit(0.0).alias("floor")) if best is None else closure.join(best, "idx").select("plan_id", "idx", floor.alias("floor"))
    floors = saved(floors, "floors")
    rest = floors.groupBy("plan_id").agg(F.sum("floor").alias("rest"))
    open_ = plans.join(direct.where(F.col("total_cost") < float("inf")).select("plan_id", F.col("total_cost").alias("bound")), "plan_id").join(rest, "plan_id", "left")
    at = saved(open_.select("plan_id", "goal", "bound", "state", F.lit(0.0).alias("total"), _nothing().alias("path"), F.coalesce("rest", F.lit(0.0)).alias("rest")), "level")
    ended = at.where(contains(F.col("state"), F.col("goal"))).select("plan_id", "total", "path")
    while True:
        at = at.where(~contains(F.col("state"), F.col("goal")))
        if at.isEmpty():
            break
        steps = costed(expand(at, graph), estimator, t_penalty, risk).join(floors, ["plan_id", "idx"], "left")
        steps = steps.withColumns({"total": F.col("total") + F.col("cost"), "path": F.concat("path", F.array("node_id")), "rest": F.col("rest") - F.coalesce("floor", F.lit(0.0))})
        kept = steps.where(F.col("total") + F.col("rest") <= F.col("bound") + 1e-6)
        choice = F.min(F.struct(F.round("total", PLACES).alias("r"), "path", "total", "rest")).alias("c")
        at = saved(kept.groupBy("plan_id", "goal", "bound", F.col("next").alias("state")).agg(choice).select("plan_id", "goal", "bound", "state", "c.total", "c.path", "c.rest"), "level")
        ended = ended.union(at.where(contains(F.col("state"), F.col("goal"))).select("plan_id", "total", "path"))
    best_of = ended.groupBy("plan_id").agg(F.min(F.struct(F.round("total", PLACES).alias("r"), "path", "total")).alias("c"))
    return plans.select("plan_id").join(best_of, "plan_id", "left").select("plan_id", F.coalesce("c.total", F.lit(float("inf"))).alias("total_cost"), F.coalesce("c.path", _nothing()).alias("path"))


def greedy_plans(plans: DataFrame, graph: Graph, estimator: Estimator, *, t_penalty: float = 300.0, risk: float = 0.0) -> DataFrame:
    """plan_id, total_cost, path when always the cheapest allowed node comes next, the smaller id at ties; inf and the path so far if stuck."""
    at = saved(plans.select("plan_id", "goal", "state", F.lit(0.0).alias("total_cost"), _nothing().alias("path")), "level")
    ended = at.limit(0).select("plan_id", "total_cost", "path")
    while True:
        ended = ended.union(at.where(contains(F.col("state"), F.col("goal"))).select("plan_id", "total_cost", "path"))
        at = at.where(~contains(F.col("state"), F.col("goal")))
        if at.isEmpty():
            return ended
        steps = costed(expand(at.select("plan_id", "state"), graph), estimator, t_penalty, risk)
        pick = steps.groupBy("plan_id").agg(F.min(F.struct("cost", "node_id", "next")).alias("c"))
        now = saved(at.join(pick, "plan_id", "left"), "level")
        ended = ended.union(now.where("c is null").select("plan_id", F.lit(float("inf")).alias("total_cost"), "path"))
        at = now.where("c is not null").select("plan_id", "goal", F.col("c.next").alias("state"), (F.col("total_cost") + F.col("c.cost")).alias("total_cost"), F.concat("path", F.array("c.node_id")).alias("path"))


def bottlenecks(planned: DataFrame, plans: DataFrame, graph: Graph, estimator: Estimator) -> DataFrame:
    """plan_id, node_id, p_succ of a path's least likely step, the earliest at ties; (-1, 1.0) for an empty path."""
    scored = estimator.score(along(planned, plans, graph))
    worst = scored.groupBy("plan_id").agg(F.min(F.struct(F.least("p", F.lit(1.0)).alias("p"), "pos", "node_id")).alias("w"))
    return planned.select("plan_id").join(worst, "plan_id", "left").select("plan_id", F.coalesce("w.node_id", F.lit(-1)).alias("node_id"), F.coalesce("w.p", F.lit(1.0)).alias("p_succ"))


def frequency_estimator(table: DataFrame) -> Estimator:
    """Scores from a table idx, p, var, t_base, which ignores the state."""
    side = sized(table.select("idx", "p", "var", "t_base"))  # a row for each node
    return Estimator(lambda steps: steps.join(side, "idx"), state_free=True)


def sampled_targets(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n of the nodes without replacement: those with the least hash of seed and id."""
    return nodes.select("node_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("node_id").cast("string")).cast("binary")), "node_id").limit(n)
