"""Sequence packing as a cutting-stock problem, solved by column generation.

Every document becomes token ids plus an end id and is cut into pieces of at most ``size`` ids: whole sequences first, then
the rest. The pieces' lengths, rounded up to units of ``size / UNITS``, make a histogram of at most UNITS classes. A linear
program over patterns (how many pieces of each class fill a sequence) starts from one-class patterns; an unbounded knapsack
dynamic program over the dual prices finds the next column, until no pattern prices above its cost or the bound is close.
Pattern counts are rounded down and what is left is packed first-fit decreasing. Only the histogram reaches the driver.
Pieces are then ranked inside their class (range partitions, counts, offsets; no class needs to fit one task), and the
pattern table turns a rank into a sequence and a slot.

Defined results: a null text counts as empty and is the end id alone; rows with a null or repeated key are packed like any
other; an empty table gives no rows; a very long text is tokenized whole by one task and cut into pieces like any other. Only key and
text are read, so other columns may have any name, and keys any type that a string can be cast to.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

UNITS = 256


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to lists of ids, the same ids as the tokenizer file gives.

    The file's vocabulary is run by the faster of two libraries; texts with the file's special tokens go to the other.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    said = json.load(open(path, encoding="utf-8"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = [t["content"] for t in said["added_tokens"]]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return slow[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens for each piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for b in batches:
            out = []
            for key, t in zip(b["key"], b["text"]):
                ids = np.array([*encode(t), end_id], "<u4")
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    out.append((key, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pd.DataFrame(out, columns=["key", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    made = source.mapInPandas(run, "key string, start long, length long, ids_crc32 long, doc_tokens long")
    return made.withColumn("key", F.col("key").cast(docs.schema[key].dataType))


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: class w (0-based, w + 1 units) may be used any number of times."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        n = min(c, len(prices))
        value = prices[:n] + best[c - 1 :: -1][:n]
        w = int(value.argmax())
        best[c], last[c] = (value[w], w + 1) if value[w] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(len(prices), int), capacity
    while c > 0:
        if last[c]:
            pattern[last[c] - 1] += 1
        c -= last[c] or 1
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, capacity: int, gap: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns and their (fractional) counts in the linear program's optimum, by the revised simplex method."""
    used = np.flatnonzero(demand)
    widths, need = used + 1, demand[used].astype(float)
    m = len(used)
    if not m:
        return []
    need += np.random.default_rng(0).uniform(0, 1e-4, m)  # against degenerate pivots
    fit = capacity // widths
    columns = np.diag(fit).astype(float)
    inverse, x = np.diag(1 / fit), need / fit
    for _ in range(40 * m):  # far above what is needed; the rounding below makes good any set of patterns
        dual = inverse.sum(axis=0)  # every pattern costs one sequence
        prices = np.zeros(capacity)
        prices[used] = dual
        value, pattern = knapsack(prices, capacity)
        if value <= 1 + 1e-9 or x.sum() <= (dual @ need) / value * (1 + gap):
            break
        column = pattern[used].astype(float)
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        theta = ratio[leave]
        x = np.maximum(x - theta * step, 0)
        x[leave] = theta
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        columns[:, leave] = column
    out = []
    for i in range(m):
        if x[i] > 0:
            pattern = np.zeros(len(demand), int)
            pattern[used] = columns[:, i].astype(int)
            out.append((pattern, float(x[i])))
    return out


def patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns and counts that use up the demand exactly."""
    left, out = demand.copy(), []
    for pattern, count in column_generation(demand, capacity):
        used = pattern > 0
        n = int(min(np.floor(count + 1e-6), (left[used] // pattern[used]).min()))
        if n > 0:
            out.append((pattern, n))
            left -= n * pattern
    while left.any():  # first-fit decreasing, a pattern at a time
        pattern, room = np.zeros_like(left), capacity
        for w in np.flatnonzero(left)[::-1]:
            n = min(int(left[w]), room // (int(w) + 1))
            pattern[w] += n
            room -= n * (int(w) + 1)
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        out.append((pattern, n))
        left -= n * pattern
    return out


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    spark, unit = docs.sparkSession, -(-size // UNITS)
    capacity = size // unit
    made = pieces(docs, tokenizer, key=key, text=text, size=capacity * unit, end_id=end_id).withColumn("w", F.ceil(F.col("length") / unit).cast("int"))
    made = saved(made, "pieces")
    order = ("w", "key", "start", "ids_crc32")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(made.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part", "w").agg(F.count("*").alias("n"))  # a class per range, so about ranges + classes rows
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("w").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("part", "w", F.coalesce("before", F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("part", "w").orderBy(*order)) - 1
    ranked = ranged.withColumn("rank", local).join(F.broadcast(before), ["part", "w"]).withColumn("rank", F.col("rank") + F.col("before"))

    demand = np.zeros(capacity, int)
    for r in counts.groupBy("w").agg(F.sum("n").alias("n")).collect():
        demand[r.w - 1] = r.n
    rows, sequence, done = [], 0, np.zeros(capacity, int)
    for pattern, times in patterns(demand, capacity):
        slot = 0
        for w in np.flatnonzero(pattern)[::-1]:
            each = int(pattern[w])
            rows.append((int(w) + 1, int(done[w]), int(done[w]) + each * times, sequence, each, slot))
            done[w] += each * times
            slot += each
        sequence += times
    plan = spark.createDataFrame(rows, "w int, first long, beyond long, sequence long, each long, slot long")
    placed = ranked.join(F.broadcast(plan), (ranked["w"] == plan["w"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
    at = F.col("rank") - F.col("first")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor(at / F.col("each")).cast("long")).withColumn("slot", F.col("slot") + at % F.col("each"))
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(ahead, F.lit(0)).alias("offset"))
