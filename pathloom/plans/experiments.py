"""Strategies by targets: plans, trajectories, comparisons, exports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.store import saved
from pathloom.operators import planner
from pathloom.operators.planner import Estimator


@dataclass(frozen=True)
class Strategy:
    name: str
    estimator: Estimator
    greedy: bool = False
    risk: float = 0.0


def strategies(monotone: Estimator, frequency: Estimator, risk: float = 0.5) -> list[Strategy]:
    return [Strategy("risk_dp", monotone, risk=risk), Strategy("neutral_dp", monotone), Strategy("greedy", monotone, greedy=True), Strategy("freq_dp", frequency)]


def trajectories(chosen: list[Strategy], targets: DataFrame, nodes: DataFrame, edges: DataFrame, t_penalty: float = 300.0) -> DataFrame:
    """target_node, strategy_name, path, expected_total_cost, path_length, bottleneck_node for every pair, from nothing mastered."""
    graph = planner.prepare(nodes, edges)
    plans = saved(planner.plans_for(targets, graph), "plans")
    closure = planner.closures(plans, graph)

    def one(s: Strategy) -> DataFrame:
        how = {"t_penalty": t_penalty, "risk": s.risk}
        planned = saved(planner.greedy_plans(plans, graph, s.estimator, **how) if s.greedy else planner.dp_plans(plans, graph, s.estimator, closure=closure, **how), "planned")
        worst = planner.bottlenecks(planned, plans, graph, s.estimator)
        worst = worst.select("plan_id", F.struct("node_id", F.round("p_succ", 6).alias("p_succ")).alias("bottleneck_node"))
        return planned.join(worst, "plan_id").select(F.col("plan_id").alias("target_node"), F.lit(s.name).alias("strategy_name"), "path", F.col("total_cost").alias("expected_total_cost"), F.size("path").cast("bigint").alias("path_length"), "bottleneck_node")

    return reduce(DataFrame.union, map(one, chosen))


def metrics(found: DataFrame) -> DataFrame:
    """The flat export: costs rounded to 4 places."""
    return found.select("target_node", "strategy_name", F.round("expected_total_cost", 4).alias("expected_total_cost"), "path_length", F.col("bottleneck_node.node_id").alias("bottleneck_node_id"), F.col("bottleneck_node.p_succ").alias("bottleneck_p"))


def by_strategy(found: DataFrame, value: str, *names: str) -> DataFrame:
    """target_node and one column of ``value`` for each strategy: the first match counts."""
    return found.groupBy("target_node").agg(*[F.min(F.when(F.col("strategy_name") == n, F.col(value))).alias(n) for n in names])


def compared(found: DataFrame, left: str, right: str) -> DataFrame:
    """target_node, the two costs, and how much more the first costs."""
    both = by_strategy(found, "expected_total_cost", left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return both.withColumn("diff", F.col(left) - F.col(right))


def worst_gaps(comparison: DataFrame, k: int = 5) -> DataFrame:
    return comparison.orderBy(F.desc("diff"), "target_node").limit(k)


def material(comparison: DataFrame, least: float = 0.01) -> DataFrame:
    """Targets whose costs differ by more than ``least`` either way."""
    return comparison.where(F.abs("diff") > least)


def n_worse(comparison: DataFrame, least: float = 0.01) -> DataFrame:
    return comparison.agg(F.count_if(F.col("diff") > least).alias("n_worse"), F.count("*").alias("n_targets"))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("strategy_name").agg(F.avg("expected_total_cost").alias("mean_cost"), F.stddev_pop("expected_total_cost").alias("std_cost"), F.count("*").alias("n"))


def risk_chart(found: DataFrame, neutral: str = "neutral_dp", risky: str = "risk_dp") -> DataFrame:
    """Costs and bottleneck chances with and without risk."""
    flat = metrics(found)
    cost = by_strategy(flat, "expected_total_cost", neutral, risky).select("target_node", F.col(neutral).alias("cost_neutral"), F.col(risky).alias("cost_risk"))
    p = by_strategy(flat, "bottleneck_p", neutral, risky).select("target_node", F.col(neutral).alias("p_neutral"), F.col(risky).alias("p_risk"))
    return cost.join(p, "target_node")
