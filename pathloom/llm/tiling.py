"""Benchmark decontamination by greedy string tiling.

Words of benchmark items and documents are hashed; runs of ``k`` words are seeds (Karp-Rabin hashes over prefix sums). A
document's seeds are joined with the items' seeds, as narrow rows, and counted for each (document, item) pair. A tile of L words has
L - k + 1 seeds, so ``threshold`` of an item's words takes at least that share of its words divided by k in seed places, ``least``; pairs with fewer are out
before any words are moved. A pair with ``least`` places shares one of any places but ``least`` - 1; so each item leaves its most common seeds, of ``least`` - 1 places
together, out of the join, and they are counted for the pairs only that its other seeds found. The pairs with enough are tiled: matches of k or more words are marked longest first, never overlapping one another in either text, until none is left. An item's coverage is
the share of its words under tiles; since tiles may stand in any order, reordered passages are caught too. A document with
coverage >= ``threshold`` of any item is contaminated.

Before the join, documents drop seeds that miss a Bloom filter of the items' seeds; its size is fixed, and it only spares work.

A seed that many documents and many items hold is left out of the join by all items that have rarer ones; where an item has none, its rows are narrow
and Spark splits skewed partitions of that join. Matches of texts that repeat
themselves are followed place by place, so that memory grows as the texts, not as their product.

Defined results: null texts count as empty and never match; items of fewer than k words are too short to tell from ordinary
text and never match; repeated rows on either side give repeated rows; rows with a null key take part; matches of equal length are marked in the order of their
starts in the item, then in the document; very long texts are tiled whole; empty tables give no rows. Only key and text are read of either table, so other columns may have any name, and keys any type
that a string can be cast to.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, gram_hashes, saved, text_hash, without, word_hashes

FILTER_BITS, PROBES, SHIFT = 22, 3, 20


def tiles(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of greedy tiles of at least k words, longest first."""
    if len(item) < k or len(doc) < k:
        return []
    a, b = gram_hashes(item, k), gram_hashes(doc, k)
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = int((hi - lo).sum())
    if not n:
        return []
    if n > 64 * (len(a) + len(b)):
        return _marked(*_followed(lo, hi, order, k), item, doc, k)
    i = np.repeat(np.arange(len(a)), hi - lo)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    sort = np.lexsort((i, j - i))
    i, j = i[sort], j[sort]
    new = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    return _marked(np.diff(np.r_[new, len(i)]) + k - 1, i[new], j[new], item, doc, k)


def _followed(lo: np.ndarray, hi: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Length and starts of the maximal matches, from the places of each of the item's seeds in turn."""
    begun, out, before = np.zeros(len(lo) + len(order) + 1, np.int64), [], np.zeros(0, np.int64)
    for i in range(len(lo) + 1):
        now = order[lo[i] : hi[i]] if i < len(lo) else before[:0]  # ascending, as the sort is stable
        went = before + 1
        begun[np.setdiff1d(now, went, assume_unique=True) - i + len(lo)] = i
        ended = np.setdiff1d(went, now, assume_unique=True)
        start = begun[ended - i + len(lo)]
        out.append(np.stack([i - start + k - 1, start, ended - i + start]))
        before = now
    return tuple(np.concatenate(out, axis=1))


def _marked(lengths: np.ndarray, i: np.ndarray, j: np.ndarray, item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    queue = [(-int(n), int(s), int(t)) for n, s, t in zip(lengths, i, j)]
    heapq.heapify(queue)
    in_item, in_doc, found = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while queue:
        n, s, t = heapq.heappop(queue)
        taken = in_item[s : s - n] | in_doc[t : t - n]
        if not taken.any():
            in_item[s : s - n] = in_doc[t : t - n] = True
            found.append((s, t, -n))
            continue
        edge = np.diff(np.r_[1, taken.astype(np.int8), 1])
        for x, y in zip(np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)):
            if y - x >= k:
                heapq.heappush(queue, (-int(y - x), s + int(x), t + int(x)))
    return found


def _seed_bits(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of 2**FILTER_BITS bits: PROBES windows of each seed's bits."""
    probes = [F.shiftrightunsigned("seed", p * SHIFT).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for p in range(PROBES)]
    rows = seeds.select(F.explode(F.array(*probes)).alias("p"))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    flag = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in rows.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(word).alias("bits")).toLocalIterator():
        flag[r.w] = r.bits
    return np.unpackbits(flag.view(np.uint8), bitorder="little").astype(bool)


def coverage(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.5) -> DataFrame:
    """key, text_hash, item key, item_words, covered, coverage, n_tiles, longest for every contaminated pair."""
    name, item_name = key, item_key

    @F.pandas_udf("binary")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: word_hashes(t).tobytes())

    def seeds_of(raw: bytes) -> np.ndarray:
        w = np.frombuffer(raw, U64)
        return gram_hashes(w, k).view(np.int64) if len(w) >= k else np.zeros(0, np.int64)

    @F.pandas_udf("array<bigint>")
    def seeds(raw: pd.Series) -> pd.Series:
        return raw.map(seeds_of)

    body = F.coalesce(F.col(item_text).cast("string"), F.lit(""))
    bench = saved(items.select(F.col(item_key).alias("item"), words(body).alias("item_words")).withColumn("ref", F.monotonically_increasing_id()), "items")
    least = F.ceil(F.octet_length("item_words") / 8 * threshold / k - 1e-9).cast("int")
    item_seeds = saved(bench.select("ref", least.alias("least"), F.explode(seeds("item_words")).alias("seed")).groupBy("ref", "least", "seed").agg(F.count("*").alias("places")), "item_seeds")
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(_seed_bits(item_seeds), bitorder="little"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flag = np.unpackbits(bits.value, bitorder="little").astype(bool)
        for b in batches:
            out = []
            for at, t in enumerate(b["text"]):
                w = word_hashes(t)
                if len(w) >= k:
                    g = gram_hashes(w, k)
                    for p in range(PROBES):
                        g = g[flag[((g >> U64(p * SHIFT)) & U64((1 << FILTER_BITS) - 1)).astype(np.int64)]]
                    if len(g):
                        out.append((at, w.tobytes(), np.unique(g).view(np.int64)))
            found = pd.DataFrame(out, columns=["at", "words", "seeds"])
            kept = b[["key", "text_hash"]].iloc[found["at"].astype(int)].reset_index(drop=True)
            yield pd.concat([kept, found[["words", "seeds"]]], axis=1)

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(key).cast("string").alias("key"), text_hash(text).alias("text_hash"), body.alias("text"))  # a null key stays one in pandas
    cand = source.mapInPandas(scan, "key string, text_hash long, words binary, seeds array<bigint>")
    cand = saved(cand.withColumn("row", F.monotonically_increasing_id()), "candidates")
    held = cand.select("row", F.explode("seeds").alias("seed"))
    common = held.groupBy("seed").agg(F.count("*").alias("n"))
    first = Window.partitionBy("ref").orderBy(F.desc("n"), "seed").rowsBetween(Window.unboundedPreceding, 0)  # an item's own seeds
    ranked = item_seeds.join(common, "seed").withColumn("left_out", F.sum("places").over(first) < F.col("least"))
    ranked = saved(ranked.drop("n"), "seeds")
    met = held.join(ranked.where("not left_out"), "seed").groupBy("row", "ref").agg(F.sum("places").alias("places"), F.first("least").alias("least"))
    met = saved(met, "met")
    more = met.where("places < least").select("row", "ref").join(ranked.where("left_out").select("ref", "seed", "places"), "ref").join(held, ["row", "seed"])
    more = more.groupBy("row", "ref").agg(F.sum("places").alias("more"))
    pairs = met.join(more, ["row", "ref"], "left").where(F.col("places") + F.coalesce("more", F.lit(0)) >= F.col("least")).select("row", "ref")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, i in zip(b["words"], b["item_words"]):
                item = np.frombuffer(i, U64)
                found = tiles(item, np.frombuffer(w, U64), k)
                out.append((len(item), sum(t[2] for t in found), len(found), max((t[2] for t in found), default=0)))
            yield pd.concat([b.drop(columns=["words", "item_words"]), pd.DataFrame(out, columns=["n_words", "covered", "n_tiles", "longest"], index=b.index)], axis=1)

    both = pairs.join(cand.drop("seeds"), "row").join(bench.withColumn("item", F.col("item").cast("string")), "ref")
    both = both.select("key", "text_hash", "item", "words", "item_words")
    done = both.mapInPandas(tile, "key string, text_hash long, item string, n_words long, covered long, n_tiles long, longest long")
    share = F.col("covered") / F.col("n_words")
    return done.where(share >= threshold).select(
        F.col("key").cast(docs.schema[key].dataType).alias(name), "text_hash", F.col("item").cast(items.schema[item_key].dataType).alias(item_name), F.col("n_words").alias("item_words"), "covered", share.alias("coverage"), "n_tiles", "longest"
    )


def decontaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that cover no item, all columns kept."""
    found = saved(coverage(docs, items, key=key, text=text, **how).select(key, "text_hash"), "contaminated")
    return without(docs, found, key=key, text=text)
