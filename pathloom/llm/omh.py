"""Near-duplicate documents by order MinHash, verified by banded alignment.

A text's words give runs of ``k`` = 5 words; each run carries its occurrence number in the text. A sketch takes the
``ell`` runs of least hash and joins them in text order, so that two texts share it only if the runs stand in the same
order. As many sketches again are made of runs of ``short`` = 3 words, for meeting only: scattered edits leave more of them whole.
Texts that share any one of these 2 * ``sketches`` sketches meet in a bucket. A pair is a link if
1 - (word edit distance) / (words of the longer text) >= ``similarity``.

Buckets are compared in rounds, a few sketches first and then the rest. What a round links is one component, and later buckets
that hold one component only are left out, as they could join nothing. No pair of different components is left out of a
bucket: buckets of the same texts count once, and large buckets are cut into blocks of about ``block`` texts,
each two of which are a cell for one task, so that a bucket is no task's load alone. A cell is first read with FOLD
counts of each text's words, which bound the distance from below; only texts with a partner within the bound come back with
their words, in smaller cells of about ``cell`` texts and ``most_words`` words a side, for the alignment: a bit-parallel dynamic program that fills the band that the limit allows. The bounds are
exact, so a link is lost only where two texts share no sketch at all. The work for a bucket of texts that are unlike each
other grows with its square, at some tenths of a microsecond for a pair.
Equal texts are one node from the start. Classes are the connected components.

Defined results: a null text counts as empty; texts without words are alike only if equal; texts of fewer than k words are
one run; a row with a null id takes part like any other (a class of null ids only has a null class id); repeated rows
give repeated rows; a very long text takes memory in proportion to its words; an empty table gives no rows. Only id and text
are read, so other columns may have any name, and ids any type that can be ordered.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bit_set, first_seen, gram_hashes, in_set, mix, saved, word_hashes
from .components import components

FOLD = 128
#: Words of a long text that keep a bit set of their places; the others keep a list.
FREQUENT = 256
#: Sets the sketches of short runs apart.
SHORT = 0x5851F42D4C957F2D


def occurrence_labelled(grams: np.ndarray) -> np.ndarray:
    """Hashes of (run, occurrence number), so that repeated runs count as often as they stand."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if new.all():
        return mix(grams)
    at = np.arange(len(grams))
    occurrence = np.empty(len(grams), U64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(U64)
    return mix(grams + occurrence * U64(0xD6E8FEB86659FD93))


def order_minhash(words: np.ndarray, k: int, ell: int, sketches: int) -> np.ndarray:
    """One 64-bit sketch for each of the hash functions; none for a text without words."""
    if not len(words):
        return np.zeros(0, np.int64)
    h = occurrence_labelled(gram_hashes(words, k))
    seeds = mix(np.arange(1, sketches + 1).astype(U64) * U64(0xA0761D6478BD642F))[:, None]
    if len(h) > ell:
        chosen, step = [], max(1, (1 << 19) // len(h))  # a long text takes a few hash functions at a time
        for i in range(0, sketches, step):
            hashed = (h[None, :] ^ seeds[i : i + step]) * (seeds[i : i + step] | U64(1))
            hashed ^= hashed >> U64(32)
            chosen.append(np.argpartition(hashed, ell - 1, axis=1)[:, :ell])
        picked = h[np.sort(np.concatenate(chosen), axis=1)]
    else:
        picked = np.broadcast_to(h, (sketches, len(h)))
    out = seeds[:, 0].copy()
    for i in range(picked.shape[1]):
        out = mix(out * U64(3) + picked[:, i])
    return out.view(np.int64)


def places(a: list[int]) -> Callable[[int, int, int], int]:
    """A function of (x, start, width): bit i - start for each place i of x from start on; bits from ``width`` on don't count.

    Bit sets are kept for the FREQUENT commonest words only, so memory grows as the text, not as its square.
    """
    sets: dict[int, int] = {}
    if len(a) <= 8 * FREQUENT:
        for i, x in enumerate(a):
            sets[x] = sets.get(x, 0) | 1 << i
        return lambda x, start, width: sets.get(x, 0) << -start if start < 0 else sets.get(x, 0) >> start
    lists: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        lists.setdefault(x, []).append(i)
    for x in sorted(lists, key=lambda x: -len(lists[x]))[:FREQUENT]:
        raw = np.zeros(len(a) + 1, np.uint8)
        raw[lists[x]] = 1
        sets[x] = int.from_bytes(np.packbits(raw, bitorder="little").tobytes(), "little")

    def of(x: int, start: int, width: int) -> int:
        if x in sets:
            return sets[x] << -start if start < 0 else sets[x] >> start
        found, bits = lists.get(x, ()), 0
        for i in found[bisect_left(found, start) : bisect_left(found, start + width)]:
            bits |= 1 << (i - start)
        return bits

    return of


def banded_distance(a: list[int], b: list[int], limit: int) -> int:
    """Edit distance of two sequences, or limit + 1 if it is more; only cells within ``limit`` of the diagonal are filled.

    A column of the band is held as two bit sets (rises and falls of one), after Hyyrö's banded form of Myers' algorithm.
    """
    if len(a) < len(b):
        a, b = b, a
    lo = 0
    while lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    m, n = len(a), len(b)
    if m - n > limit or not n:
        return min(m, limit + 1)
    limit_given, limit = limit, min(limit, m - 1)
    width = 2 * limit + 2
    full, top = (1 << width) - 1, width - 1
    at_of = places(a)
    rise, fall, distance = full ^ ((1 << (width - limit - 1)) - 1), 0, limit
    start, edge = limit + 1 - width, 1 << (top - 1)
    for j, x in enumerate(b):
        at = at_of(x, start, width) & full
        same = (((((at & rise) + rise) & full) ^ rise) | at | fall) & full
        right, left = fall | (full & ~(same | rise)), same & rise
        if j < m - limit:
            distance += not same >> top & 1
        else:
            distance += bool(right & edge)
            distance -= bool(left & edge)
            edge >>= 1
        same >>= 1
        rise, fall = left | (full & ~(same | right)), same & right
        start += 1
        if distance - max(0, n - j - 1 - max(0, m - limit - j - 1)) > limit_given:
            return limit_given + 1
    return min(distance, limit_given + 1)


def labelled(words: np.ndarray) -> np.ndarray:
    """Sorted hashes of (word, occurrence number)."""
    return np.sort(occurrence_labelled(words.astype(U64))) if len(words) else words.astype(U64)


def n_common(a: np.ndarray, b: np.ndarray) -> int:
    """Values of a in b; both sorted and distinct."""
    if not len(a) or not len(b):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def alike(x: np.ndarray, y: np.ndarray, similarity: float, x_set: np.ndarray | None = None, y_set: np.ndarray | None = None) -> bool:
    """Whether two texts' words are a link; the sets are their ``labelled`` words, if at hand."""
    longer = max(len(x), len(y))
    limit = int((1 - similarity) * longer + 1e-9)
    if abs(len(x) - len(y)) > limit:
        return False
    if longer - n_common(labelled(x) if x_set is None else x_set, labelled(y) if y_set is None else y_set) > limit:
        return False
    return banded_distance(x.tolist(), y.tolist(), limit) <= limit


def _nodes(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(body.cast("binary"))).alias("node"), body.alias("text"))


def folded(words: np.ndarray) -> bytes:
    """How many words fall on each of FOLD places, in the narrowest type that holds them."""
    n = np.bincount(words % FOLD, minlength=FOLD)
    return n.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if n.max() <= np.iinfo(t).max)).tobytes()


def unfolded(raw: list[bytes]) -> np.ndarray:
    kinds = {FOLD: np.uint8, 2 * FOLD: np.uint16, 4 * FOLD: np.uint32}
    parts = [np.frombuffer(r, kinds[len(r)]) for r in raw]
    return np.stack([p.astype(max(p.dtype for p in parts)) for p in parts])


def within_bound(size: np.ndarray, counts: np.ndarray, x: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Those of ``others`` that may be alike to x, by lengths and folded counts."""
    longer = np.maximum(size[others], size[x])
    limit = ((1 - similarity) * longer + 1e-9).astype(int)
    near = np.abs(size[others] - size[x]) <= limit
    others, longer, limit = others[near], longer[near], limit[near]
    return others[longer - np.minimum(counts[others], counts[x]).sum(axis=1, dtype=np.int64) <= limit]


def plausible(size: np.ndarray, counts: np.ndarray, earlier: np.ndarray, label: np.ndarray, split: int, similarity: float) -> np.ndarray:
    """A flag for each text of a cell that has a partner of another component within the bound, with which it shares no earlier sketch."""
    found = np.zeros(len(size), bool)
    for x in range(split or len(size) - 1):
        first = split or x + 1
        others = first + np.flatnonzero((label[first:] != label[x]) & ~(found[first:] & found[x]))
        near = within_bound(size, counts, x, others, similarity)
        near = near[~(earlier[near] == earlier[x]).any(axis=1)]
        found[near] = True
        found[x] |= len(near) > 0
    return found


def cell_links(words: list[np.ndarray], earlier: np.ndarray, label: np.ndarray, split: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links that join all that is alike in a cell: of any two texts, or if ``split`` of one before it with one from it on.

    ``label`` tells the components so far, which need no link inside. ``earlier`` are the texts' sketches before the
    bucket's own: pairs that share one of these are left to the bucket of that one.
    """
    label = label.copy()
    size, sets = np.array([len(w) for w in words]), [labelled(w) for w in words]
    counts = unfolded([folded(w) for w in words])
    for x in range(split or len(words) - 1):
        first = split or x + 1
        others = within_bound(size, counts, x, first + np.flatnonzero(label[first:] != label[x]), similarity)
        for y in others[~(earlier[others] == earlier[x]).any(axis=1)].tolist():
            if label[x] != label[y] and alike(words[x], words[y], similarity, sets[x], sets[y]):
                label[label == label[y]] = label[x]
                yield x, y


def _in_cells(rows: DataFrame, work: Callable[[list[tuple], np.ndarray, int], list[tuple]], payload: tuple[str, ...], out: str) -> DataFrame:
    """Deal rows by (bucket, i, j) and call ``work`` (rows, labels, split) for each cell; a row is bucket, i, j, node, then ``payload``."""
    names = [f.split()[0] for f in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held = None, []

        def ended() -> list[tuple]:
            split = sum(r[4] for r in held)
            split = len(held) - split if split else 0
            if len(held) < 2 or not split and cell[1] != cell[2]:
                return []
            label = np.unique(np.array([r[5] for r in held], object), return_inverse=True)[1]
            return work([(*r[:4], *r[6:]) for r in held], label, split) if label.any() else []

        for b in batches:
            made = []
            for r in zip(b["bucket"], b["i"], b["j"], b["node"], b["side"], b["root"], *(b[c] for c in payload)):
                if r[:3] != cell:
                    made += ended()
                    cell, held = r[:3], []
                held.append(r)
            if made:
                yield pd.DataFrame(made, columns=names)
        if made := ended():
            yield pd.DataFrame(made, columns=names)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "node").mapInPandas(run, out)


def _words_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """node, words (32 bits of each word's hash) of the wanted nodes. Only their texts' words are shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(wanted.select(F.xxhash64("node").alias("h")), "h", 23))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[bytes] = set()
        for b in batches:
            b = b[in_set(bits.value, b["h"].to_numpy())]
            b = b[np.array([first_seen(done, bytes(n)) for n in b["node"]], bool)]
            yield pd.DataFrame({"node": b["node"], "words": [word_hashes(t).astype(np.uint32).tobytes() for t in b["text"]]})

    found = _nodes(docs, text).withColumn("h", F.xxhash64("node")).mapInPandas(run, "node binary, words binary")
    return found.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))


def _sketched(docs: DataFrame, text: str, k: int, short: int, ell: int, sketches: int) -> DataFrame:
    """node, n_words, folded, sketches (of long and short runs in turn); a text with copies in several tasks has a row in each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[bytes] = set()
        for b in batches:
            out = []
            for node, t in zip(b["node"], b["text"]):
                if first_seen(done, node := bytes(node)) and len(found := word_hashes(t)):
                    both = [order_minhash(found, k, ell, sketches), order_minhash(found, short, ell, sketches) ^ SHORT]
                    out.append((node, len(found), folded(found.astype(np.uint32)), np.stack(both, axis=1).reshape(-1)))
            yield pd.DataFrame(out, columns=["node", "n_words", "folded", "sketches"])

    return saved(_nodes(docs, text).mapInPandas(run, "node binary, n_words int, folded binary, sketches array<bigint>"), "sketches")


def _meetings(made: DataFrame, bits, roots: DataFrame | None, low: int, high: int, block: int) -> DataFrame:
    """bucket, i, j, side, at, node, root, n_words: the cells of the buckets of sketches ``low`` to ``high`` - 1 that hold two components or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                bucket, n = np.concatenate(b["s"].to_list()), b["s"].map(len)
                ok = in_set(bits.value, bucket)
                at = low + np.tile(np.arange(high - low), len(b))
                yield pd.DataFrame({"node": b["node"].repeat(n).to_numpy()[ok], "n_words": b["n_words"].repeat(n).to_numpy()[ok], "at": at[ok], "bucket": bucket[ok]})

    rows = made.select("node", "n_words", F.slice("sketches", low + 1, high - low).alias("s")).mapInPandas(run, "node binary, n_words int, at int, bucket long").distinct()
    rows = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = saved(rows, "meet")
    buckets = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("at").alias("at"), F.min("root").alias("a"), F.max("root").alias("b"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    ).where("a < b")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("at", "bucket")).alias("first"))  # of buckets of the same texts the first
    buckets = buckets.select("first.bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.join(buckets, "bucket").withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "at", "node", "root", "n_words")


def _smaller(rows: DataFrame, cell: int, most_words: int) -> DataFrame:
    """Cut the cells further, in the same manner: pairs of parts of one side, or of one part of each side."""
    key = ["bucket", "i", "j"]
    parts = rows.groupBy(*key).agg(F.ceil(F.greatest(F.count("*") / cell, F.sum("n_words") / most_words)).cast("int").alias("parts"))
    rows = rows.join(parts, key).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    inside, left = F.col("i") == F.col("j"), F.col("side") == 0
    i = F.when(inside, F.least("own", "with")).when(left, F.col("own")).otherwise(F.col("with"))
    j = F.when(inside, F.greatest("own", "with")).otherwise(F.col("parts") + F.when(left, F.col("with")).otherwise(F.col("own")))
    side = F.when(inside, F.col("own") > F.col("with")).otherwise(~left).cast("int")
    return rows.withColumns({"bucket": F.xxhash64(*key), "i": i, "j": j, "side": side}).drop("own", "with", "parts", "n_words")


def links(docs: DataFrame, *, text: str = "text", k: int = 5, short: int = 3, ell: int = 2, sketches: int = 32, similarity: float = 0.8, block: int = 2000, cell: int = 400, most_words: int = 1_000_000, first: int = 8) -> DataFrame:
    """node, rep: verified links between different texts (md5 of each), enough to join all that is alike in a bucket."""
    made = _sketched(docs, text, k, short, ell, sketches)
    repeated = made.select(F.explode("sketches").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(repeated, "bucket"))
    found, roots = None, None

    def flagged(rows: list[tuple], label: np.ndarray, split: int) -> list[tuple]:
        keep = plausible(np.array([r[4] for r in rows]), unfolded([r[5] for r in rows]), np.stack([r[6] for r in rows]), label, split, similarity)
        return [(*r[:3], int(split > 0 and at >= split), *r[3:5], *r[6:]) for at, (r, ok) in enumerate(zip(rows, keep)) if ok]

    def linked(rows: list[tuple], label: np.ndarray, split: int) -> list[tuple]:
        found = cell_links([np.frombuffer(r[4], np.uint32) for r in rows], np.stack([r[5] for r in rows]), label, split, similarity)
        return [(rows[x][3], rows[y][3]) for x, y in found]

    for low, high in ((0, first), (first, 2 * sketches)):
        cells = saved(_meetings(made, bits, roots, low, high, block), "cells")
        known = made.join(cells.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("folded").alias("folded"), F.first("sketches").alias("sketches"))
        rows = cells.join(known, "node").withColumn("earlier", F.slice("sketches", 1, F.col("at"))).withColumn("same_root", F.col("root")).drop("sketches", "at")
        near = _in_cells(rows, flagged, ("n_words", "folded", "earlier", "same_root"), "bucket long, i int, j int, side int, node binary, n_words int, earlier array<bigint>, root binary")
        near = saved(near, "near")
        words = _words_of(docs, text, near.select("node").distinct())
        new = saved(_in_cells(_smaller(near, cell, most_words).join(words, "node"), linked, ("words", "earlier"), "node binary, rep binary"), "links")
        found = new if found is None else found.union(new)
        if high < 2 * sketches:
            roots = components(found, "node", "rep")
    return found


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """key, class_id, class_size, node (md5 of the text) for every row: the least key of its class, and how many rows it has."""
    ids = docs.select(F.col(key).alias("key"), F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))).alias("node"))
    ids = saved(ids, "ids")
    roots = components(links(docs, text=text, **how), "node", "rep")
    nodes = ids.groupBy("node").agg(F.min("key").alias("first"), F.count("*").alias("n")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = saved(nodes, "nodes")
    by_root = nodes.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    to_class = saved(nodes.join(by_root, "root").select("node", "class_id", "class_size"), "classes")
    return ids.join(to_class, "node").select(F.col("key").alias(key), "class_id", "class_size", "node")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that stand for their class, all columns kept: those with the class's least key.

    Of rows that agree in key and text one stays, and so does, of texts that share the least key, the one of least md5.
    """
    found = saved(classes(docs, key=key, text=text, **how), "found")
    heads = found.where(F.col(key).eqNullSafe(F.col("class_id"))).groupBy("class_id", key).agg(F.min("node").alias("node"), F.count("*").alias("rows"))
    heads = saved(heads, "heads")
    gone = found.join(heads.select(F.col(key).alias("_key"), F.col("node").alias("_node")), F.col(key).eqNullSafe(F.col("_key")) & (F.col("node") == F.col("_node")), "left_anti")
    gone = saved(gone.select(F.col(key), "node").distinct(), "gone")
    node = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    least = gone.select(F.col(key).alias("_key"), F.col("node").alias("_node"))
    if least.count() <= 1_000_000:
        least = F.broadcast(least)
    rows = docs.withColumn("_md5", node).join(least, docs[key].eqNullSafe(least["_key"]) & (F.col("_md5") == least["_node"]), "left_anti")
    twice = heads.where("rows > 1")
    if not twice.isEmpty():  # repeats of the row that stays
        rows = rows.dropDuplicates([key, "_md5"])
    return rows.drop("_md5")

