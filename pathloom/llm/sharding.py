"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

All orders of the rows are equally likely, and the shards' counts differ by one row at most. Each shard is a run of cells of some CELL rows; cells,
not shards, are what a task sorts, so a shard may have any size. Four steps:

1. Exact counts. With n(p) rows in source partition p and s(c) places in cell c, the number of rows that p sends to c is a contingency table
   with these margins. It is drawn as a tree: a node splits its places among the two halves of its partitions by a multivariate hypergeometric draw,
   seeded by the node. A task walks from the root down to its own partition, so that the matrix (partitions x cells) is nowhere as a whole, and
   all tasks, and repeated ones, see the same matrix.
2. Local permutation: a partition's row of the matrix, spelled out as labels and shuffled, gives each of its rows a cell.
3. Exchange: rows go to their cells by a shuffle with even parts, whatever the keys; hot keys are no load, as no key is looked at.
4. Second permutation: a cell's rows are sorted by a hash of seed and place; the slot is the cell's first slot and the row's rank.

The rows are first written with their partition and place, and all draws depend on these and the seed alone, so a lost executor changes nothing.
The driver holds one count for each source partition.

Defined results: null, empty and very long texts, null keys, ties and repeated rows are rows like others; an empty table gives no rows; fewer rows than
shards leave shards empty. Columns are kept; names that start with ``_shard_`` are for use inside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

CELL, MOST_CELLS = 100_000, 100_000
#: numpy draws hypergeometric numbers from fewer than this many things.
MOST = 1_000_000_000


def log_factorial_ratio(a: int, b: int) -> float:
    """log(a! / b!) for large numbers that are near each other, without the loss of two large logarithms' difference."""
    if min(a, b) < 64:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    tail = lambda n: 1 / (12 * n) - 1 / (360 * n**3)
    return (a + 0.5) * math.log1p((a - b) / b) + (a - b) * (math.log(b) - 1) + tail(a) - tail(b)


def hypergeometric(r: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` things are good. Beyond numpy's limit by ratio of uniforms around the mode."""
    if good + bad < MOST:
        return int(r.hypergeometric(good, bad, drawn))
    if not good or not bad or not drawn or drawn == good + bad:
        return min(good, drawn)
    low, high = max(0, drawn - bad), min(good, drawn)
    total = good + bad
    mode = (drawn + 1) * (good + 1) // (total + 2)
    var = drawn * (good / total) * (bad / total) * ((total - drawn) / (total - 1))
    centre, width = drawn * good / total + 0.5, 1.7155277699214135 * math.sqrt(var + 0.5) + 0.898916162058898  # fixed values: sqrt(8 / e), 3 - 2 sqrt(3 / e)
    while True:
        u, v = 1 - r.random(), r.random()
        x = math.floor(centre + width * (v - 0.5) / u)
        if low <= x <= high:
            ratio = sum(log_factorial_ratio(a, b) for a, b in ((mode, x), (good - mode, good - x), (drawn - mode, drawn - x), (bad - drawn + mode, bad - drawn + x)))
            if 2 * math.log(u) <= ratio:
                return x


def spread(r: np.random.Generator, places: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` rows take places in each cell: a multivariate hypergeometric draw, marginal by marginal."""
    if places.sum() < MOST:
        return r.multivariate_hypergeometric(places, drawn, method="marginals")
    out, rest = np.zeros_like(places), int(places.sum())
    for i, n in enumerate(places.tolist()):
        out[i] = hypergeometric(r, n, rest - n, drawn)
        rest, drawn = rest - n, drawn - int(out[i])
    return out


def matrix_row(counts: np.ndarray, places: np.ndarray, part: int, seed: int) -> np.ndarray:
    """How many rows source ``part`` sends to each cell: the draws from the root of the tree down to it."""
    low, high, ahead = 0, len(counts), np.concatenate([[0], np.cumsum(counts)])
    while high - low > 1:
        middle = (low + high) // 2
        left = spread(np.random.default_rng((seed, low, high)), places, int(ahead[middle] - ahead[low]))
        low, high, places = (low, middle, left) if part < middle else (middle, high, places - left)
    return places


def cells(n: int, shards: int, cell: int = CELL) -> pd.DataFrame:
    """shard, first slot and places of each cell; cells grow with the rows beyond some MOST_CELLS of them, so that a row of the matrix stays small."""
    out, cell = [], max(cell, n // MOST_CELLS)
    for s in range(shards):
        size = n // shards + (s < n % shards)
        k = max(1, -(-size // cell))
        edge = [size * i // k for i in range(k + 1)]
        out += [(s, a, b - a) for a, b in zip(edge, edge[1:])]
    return pd.DataFrame(out, columns=["shard", "first", "places"])


def shuffled(rows: DataFrame, shards: int, *, seed: int = 42, cell: int = CELL) -> DataFrame:
    """The rows with shard and slot (their place in it, gapless from 0)."""
    spark, inside = rows.sparkSession, "_shard_part _shard_place _shard_cell _shard_first".split()
    part, place, label, first = inside
    there = F.monotonically_increasing_id()
    placed = saved(rows.withColumn(part, F.shiftright(there, 33).cast("int")).withColumn(place, there.bitwiseAND(F.lit((1 << 33) - 1))), "shuffle")
    counted = placed.groupBy(part).count().orderBy(part).collect()  # a row for each source partition
    number = {r[part]: i for i, r in enumerate(counted)}
    counts = spark.sparkContext.broadcast((number, np.array([r["count"] for r in counted], np.int64)))
    plan = cells(int(counts.value[1].sum()), shards, cell)

    @F.pandas_udf("shard int, cell int, first long")
    def target(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        at, labels = None, None
        number, sizes = counts.value
        for parts, places in batches:
            out = np.empty(len(parts), np.int64)
            for p in parts.unique():
                if p != at:  # files hold whole partitions, so this is seldom
                    r = np.random.default_rng((seed, 1 << 20, number[p]))
                    row = matrix_row(sizes, plan["places"].to_numpy(), number[p], seed)
                    at, labels = p, r.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
                here = (parts == p).to_numpy()
                out[here] = labels[places[here].to_numpy()]
            yield pd.DataFrame({"shard": plan["shard"].to_numpy()[out].astype(np.int32), "cell": out.astype(np.int32), "first": plan["first"].to_numpy()[out]})

    to = placed.withColumn("_shard_to", target(part, place)).withColumns({"shard": F.col("_shard_to.shard"), label: F.col("_shard_to.cell"), first: F.col("_shard_to.first")})
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), part, place), part, place)
    return to.withColumn("slot", (F.col(first) + F.row_number().over(order) - 1).cast("long")).drop("_shard_to", *inside)


def write_shards(rows: DataFrame, path: str, shards: int, *, seed: int = 42) -> None:
    """The shuffled rows as Parquet in a folder for each shard; a file holds whole cells, sorted by slot."""
    done = shuffled(rows, shards, seed=seed)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done.repartitionByRange(max(n, shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assigned(docs: DataFrame, shards: int = 40, *, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row; the texts themselves are not moved."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col(key), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"))
    return shuffled(narrow, shards, seed=seed).withColumn("grown_shard", F.lit(None).cast("int"))
