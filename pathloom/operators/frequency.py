"""The frequency estimator: a node's mean label, whatever the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


DEFAULT_TIME = 60.0


def global_mean(sampled: DataFrame) -> DataFrame:
    return sampled.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("global_mean"), F.count("label").alias("n_samples"))


def fit(sampled: DataFrame, nodes: DataFrame, t_base: float = 60.0) -> DataFrame:
    """node_id, idx, p, var, t_base, n; nodes without samples take the mean of all valid samples, and a negative t_base means the default."""
    t_base = DEFAULT_TIME if t_base < 0 else t_base
    valid = sampled.join(nodes.select(F.col("node_id").alias("target_node")), "target_node", "left_semi")
    by = valid.groupBy(F.col("target_node").alias("node_id")).agg(F.sum("label").alias("total"), F.count("*").alias("n"))
    overall = by.agg(F.coalesce(F.sum("total") / F.sum("n"), F.lit(0.0)).alias("mean"))
    p = F.coalesce(F.col("total") / F.col("n"), F.col("mean"))
    rows = nodes.join(by, "node_id", "left").join(F.broadcast(overall))  # one row
    return rows.select("node_id", "idx", p.alias("p"), (p * (1 - p)).alias("var"), F.lit(t_base).alias("t_base"), F.coalesce("n", F.lit(0)).alias("n"))
