"""Scans and sinks: interaction logs, item maps, edges, fixtures, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "user_id BIGINT, item_id BIGINT, is_correct INT, timestamp BIGINT"
#: The toy log (user, item, correct, time), item map and edges.
TOY_LOG = [
    (1, 101, 1, 1), (1, 100, 1, 1), (1, 200, 1, 2), (1, 201, 0, 2), (1, 300, 1, 3), (1, 301, 1, 3), (1, 400, 0, 4), (1, 100, 1, 5),
    (2, 999, 1, 1), (2, 100, 0, 2), (2, 100, 1, 3), (2, 200, 1, 4), (2, 300, 0, 5), (2, 300, 1, 5),
    (3, 100, 1, 1), (3, 101, 1, 1), (3, 200, 1, 2), (3, 201, 1, 2), (3, 300, 0, 3), (3, 301, 0, 3), (3, 400, 1, 4), (3, 400, 0, 5),
]
TOY_ITEMS = [(100, 0), (101, 0), (200, 1), (201, 1), (300, 2), (301, 2), (400, 3)]
TOY_EDGES = [(0, 1), (0, 2), (1, 3), (2, 3)]


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV log with a header; extra columns are allowed, row_id keeps the order of ties."""
    df = require_columns(spark.read.option("header", True).csv(path), "user_id", "item_id", "is_correct", "timestamp")
    cast = {c: F.col(c).cast(t) for c, t in (x.split() for x in LOG_SCHEMA.split(", "))}
    return df.withColumns(cast).withColumn("row_id", F.monotonically_increasing_id())


def item_map(spark: SparkSession, path: str | None = None, *, toy: bool = False) -> DataFrame:
    """item_id, node_id; of rows for one item the last counts, files in the order of their names. The toy map only on request."""
    if path is None:
        if not toy:
            raise ValueError("give a path, or ask for the toy map")
        return spark.createDataFrame(TOY_ITEMS, "item_id BIGINT, node_id BIGINT")
    rows = require_columns(spark.read.option("header", True).csv(path), "item_id", "node_id").withColumn("at", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()))
    return rows.groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.max_by(F.col("node_id").cast("bigint"), "at").alias("node_id"))


def edge_list(spark: SparkSession, path: str | None = None, *, toy: bool = False) -> DataFrame:
    """src, dst with duplicates kept."""
    if path is None:
        if not toy:
            raise ValueError("give a path, or ask for the toy edges")
        return spark.createDataFrame(TOY_EDGES, "src BIGINT, dst BIGINT")
    return require_columns(spark.read.option("header", True).csv(path), "src", "dst").select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))


def toy_log(spark: SparkSession) -> DataFrame:
    rows = [(*r, i) for i, r in enumerate(TOY_LOG)]
    return spark.createDataFrame(rows, LOG_SCHEMA + ", row_id BIGINT")


def write_toy_log(spark: SparkSession, path: str) -> None:
    toy_log(spark).drop("row_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an interaction log; time in whole hours, so that ties occur."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), (F.col("value") >= 35).cast("int").alias("is_correct"),
        F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("timestamp"), F.col("event_id").alias("row_id"),
    )


def events_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the events table below 90, each of the node item % 8; items from 90 on are unknown."""
    items = events_log(spark, sf_dir).where("item_id < 90").select("item_id").distinct()
    return items.select("item_id", (F.col("item_id") % 8).alias("node_id"))


def tasks_for(rows: DataFrame, most: int = 500_000) -> int:
    """Tasks of about ``most`` rows each, at least one for each core. For tables that are cheap to count."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def lineitem_log(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Orders as a larger log: customer, part, whether it was kept, order day. ``parts``: tasks of the join, if there are more than cores."""
    li, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    if parts and parts > spark.sparkContext.defaultParallelism:
        li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey")
    both = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return both.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (F.col("l_returnflag") != "R").cast("int").alias("is_correct"),
        F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("timestamp"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_id"),
    )


def write_bundle(path: str, **tables: DataFrame) -> None:
    """A stage's tables (graph, sessions, samples, weights) as Parquet, overwritten."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{n}") for n in names]


def write_trajectories(trajectories: DataFrame, path: str) -> None:
    trajectories.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
