"""Data-quality queries: each gives a count of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(sessions: DataFrame, samples: DataFrame, nodes: DataFrame, cyclic_edges: DataFrame) -> DataFrame:
    """check, n_violations for labels, contiguous session numbers, a DAG, and known nodes."""
    gaps = sessions.groupBy("user_id").agg(F.max("session_id").alias("last"), F.count("*").alias("n"), F.count_distinct("session_id").alias("d")).where("last + 1 <> n or n <> d")
    unknown = sessions.join(nodes, "node_id", "left_anti")
    rows = [("label_range", samples.where("label < 0 or label > 1 or label is null")), ("session_gaps", gaps), ("cyclic_edges", cyclic_edges), ("unknown_nodes", unknown)]
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check"), "n_violations") for name, df in rows])


def log_counts(log: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows before and after the filter, and distinct users after."""
    before = log.agg(F.count("*").alias("n_rows"))
    after = kept.agg(F.count("*").alias("n_kept"), F.count_distinct("user_id").alias("n_users"))
    return before.join(after)  # one row each
