"""Numbers for the rows of a whole table, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_of(x: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are x or less, found among the square root of them twice."""
    if not cuts:
        return F.lit(0)
    side = max(1, int(len(cuts) ** 0.5))
    all_, coarse = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[side - 1 :: side]))
    begin = F.size(F.filter(coarse, lambda q: q <= x)) * side
    return F.when(x.isNull(), 0).otherwise(begin + F.size(F.filter(F.slice(all_, begin + 1, F.lit(side)), lambda q: q <= x)))


def numbered(rows: DataFrame, name: str, lead: str, *then: str | Column) -> DataFrame:
    """Add ``name``: the row's 0-based place by the number ``lead``, then ``then``.

    Quantiles of ``lead`` cut the rows into ranges; a row's place in its range comes from a window, the ranges' own from their counts. Rows with equal
    ``lead`` are in one range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(lead, [i / ranges for i in range(1, ranges)] or [0.5], 10000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))  # fewer than ``ranges`` numbers
    rows = rows.withColumn("_range", range_of(F.col(lead), cuts))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_first(lead), *then)) - 1
    return rows.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint")).drop("_range", "_inside", "_start")
