"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else. Equal texts are one node from the start.

Positions. In each run of ``width`` neighbouring positions the one whose SEED bytes hash least is an anchor (the first of
equals), and an anchor's phrase reaches to the SEED bytes of the next one. Which positions are anchors depends on the bytes
around them alone, so copies of a string have the same anchors. ``width`` is chosen so that a string of ``length`` bytes holds
``run`` phrases from its first anchor on. A string can therefore repeat only if its first anchor's run of ``run`` phrases does, and nothing is lost
by ranking anchors instead of all positions.

Ranks. An anchor's first rank is a hash of its phrase; phrases that stand once are out at once. Then the rounds of prefix doubling, at offsets 1, 2, 4, ...:
an anchor's pair is its rank and the rank ``offset`` anchors ahead; Spark sorts the pairs that stand twice or more and their places in that order are the new
ranks, which speak for twice as many phrases; anchors whose pair is unique drop out, since no longer string from there can repeat. The rounds carry text, place and rank
only, and end when none is tied or ``run`` phrases are ranked: with run = 8 after offsets 1, 2 and 4. The last pair is taken with the bytes that
all strings with this anchor have in common, which end just under the threshold.

Strings. Anchors still tied are reported with all their strings where these agree byte for byte with another anchor's; of the others
each string of exactly ``length`` bytes is ranked. These two comparisons are by 128-bit hashes, all before them by 64-bit ones, which can
only leave more anchors tied.

Long texts are read in pieces of CHUNK bytes. In a periodic stretch neighbouring anchors have the same strings; these are known to repeat
at once, and only the stretch's ends are ranked.

Defined results: a null text counts as empty and stays null; texts shorter than ``length`` lose nothing; repeated rows are copies of
each other; rows with a null key take part like others; a very long text takes memory in proportion to CHUNK and to its tied anchors; an empty table
gives no rows. Only key and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.store import forget

from .common import U64, bit_set, first_seen, in_set, mix, prefix_hash, saved, span_hash

SEED, RUN, CHUNK = 16, 8, 1 << 20
#: An anchor: its number in the text, first and last start of its strings, ranks of its phrase and the next, hashes of what all its strings share and of all they cover.
ANCHOR = ["ord", "first", "last", "rank", "ahead", "core", "s0", "s1"]


def least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        values, step = np.minimum(values[:-step], values[step:]), step * 2
    return np.minimum(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def width_for(length: int, run: int) -> int:
    """The largest width with which a string of ``length`` bytes holds its first anchor, ``run`` phrases and the windows that made them."""
    width = (length - SEED) // (run + 1)
    if width < 2 or run < 2 or run & (run - 1):
        raise ValueError(f"run must be a power of two, and length at least {SEED + 2 * (run + 1)}")
    return width


def anchors(data: bytes, length: int, run: int) -> Iterator[tuple[np.ndarray, ...]]:
    """at, end of its phrase, first and last start of its strings (last < first for none), and a 64-bit hash of the phrase, for each piece of a text."""
    width, n, c = width_for(length, run), len(data), 0
    while n >= length and n - c >= 2 * width + SEED:
        piece = data[c : c + CHUNK + 4 * width + SEED]
        prefix = prefix_hash(np.frombuffer(piece, np.uint8).astype(U64) + U64(1))
        places = np.arange(len(piece) - SEED + 1)
        h = mix(span_hash(prefix, places, places + SEED))
        first_of = least_of_each(h >> U64(24) << U64(24) | places.astype(U64), width) & U64((1 << 24) - 1)
        new = np.flatnonzero(np.r_[True, first_of[1:] != first_of[:-1]])
        at, first = first_of[new].astype(np.int64), new
        end = at[1:] + SEED  # the last anchor opens the next piece, or has no phrase
        if len(end):
            phrase = mix(span_hash(prefix, at[:-1], end) + (end - at[:-1]).astype(U64))
            yield at[:-1] + c, end + c, first[:-1] + c, np.minimum(first[1:] - 1 + c, n - length), phrase.view(np.int64)
        if c + len(piece) == n or not len(end):
            return
        c += int(first[-1])


def whole(data: bytes, length: int, run: int) -> tuple[np.ndarray, ...] | None:
    parts = list(anchors(data, length, run))
    return tuple(map(np.concatenate, zip(*parts))) if parts else None


def digests(data: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes as pairs of 64-bit ones."""
    view = memoryview(data)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), end.tolist())]), np.int64).reshape(-1, 2)


def shared_hash(data: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans with ascending starts, by prefix sums over pieces of the text."""
    out = np.zeros(len(first), np.int64)
    for a in range(int(first[0]), len(data), CHUNK):
        here = slice(*np.searchsorted(first, [a, a + CHUNK]))
        if here.start < here.stop:
            prefix = prefix_hash(np.frombuffer(data[a : int(end[here].max())], np.uint8).astype(U64) + U64(1))
            out[here] = mix(span_hash(prefix, first[here] - a, end[here] - a)).view(np.int64)
    return out


def runs_of(flag: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true."""
    edge = np.diff(np.r_[0, flag.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def tied_anchors(data: bytes, length: int, run: int, shared: np.ndarray) -> tuple[dict[str, np.ndarray], list[tuple[int, int]]]:
    """ANCHOR columns of the anchors whose run of phrases may repeat, and (first, last) of strings known to repeat inside a period.

    These stand in stretches of ``run`` or more neighbours whose phrases may each repeat; the last of a stretch has none ahead and is left out.
    """
    found = whole(data, length, run)
    if found is None:
        return {}, []
    at, end, first, last, phrase = found
    tied = in_set(shared, phrase)
    for a, b in runs_of(tied):
        tied[a : b + 1] = b - a + 1 >= run
    ok = np.flatnonzero(tied)
    if not len(ok):
        return {}, []
    ahead = phrase[np.minimum(ok + 1, len(phrase) - 1)]
    more = np.append(np.diff(ok) == 1, False)
    at, first, last, phrase = at[ok], first[ok], last[ok], phrase[ok]
    core = at - width_for(length, run) + 1 + length
    ends = 2 * run  # anchors at each end of a periodic stretch that are ranked: those that reach into it or out of it
    asked = last >= first
    inner = shared_hash(data, at, np.where(asked, core, at))
    strings = digests(data, first, np.where(asked, last + length, first))
    same = np.zeros(len(ok), bool)
    same[1:] = asked[1:] & asked[:-1] & (np.diff(ok) == 1) & (np.diff(at - first) == 0) & (strings[1:] == strings[:-1]).all(axis=1)
    keep, known = more, []
    for a, b in runs_of(same):
        known.append((int(first[a - 1]), int(last[b])))
        keep[a - 1 + ends : max(a - 1 + ends, b - ends)] = False
    columns = [ok, first, last, phrase, ahead, inner, strings[:, 0], strings[:, 1]]
    return dict(zip(ANCHOR, [c[keep] for c in columns])), known


def counted_frames(arrays: Iterator[np.ndarray], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """key and n for the values of about ``most`` at a time."""
    held, size = [], 0
    for a in arrays:
        held.append(a)
        size += len(a)
        if size >= most:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"key": key, "n": n})
            held, size = [], 0
    if size:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        yield pd.DataFrame({"key": key, "n": n})


def open_strings(data: bytes, parts: list, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Start, 64-bit hash and asked of the strings of the parts, for parts that stand together at once."""
    parts = sorted((p["first"], p["last"], p["asked"]) for p in parts)
    i = 0
    while i < len(parts):
        j, begin = i + 1, parts[i][0]
        while j < len(parts) and parts[j][0] < parts[j - 1][1] + length and parts[j][1] - begin < CHUNK:
            j += 1
        s = np.concatenate([np.arange(a, b + 1) for a, b, _ in parts[i:j]])
        prefix = prefix_hash(np.frombuffer(data[begin : int(s[-1]) + length], np.uint8).astype(U64) + U64(1))
        h = mix(span_hash(prefix, s - begin, s - begin + length)).view(np.int64)
        yield s, h, np.repeat([p[2] for p in parts[i:j]], [p[1] - p[0] + 1 for p in parts[i:j]])
        i = j


def ranked(rows: DataFrame, first: str, *more: str) -> DataFrame:
    """first, more and rank for each pair (or single value) that occurs twice or more: ascending in the sorted order, not dense."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["first", *more]
    tied = rows.groupBy(F.col(first).alias("first"), *more).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    order = tied.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return saved(order.withColumn("rank", F.monotonically_increasing_id()), "ranks", hashes=True)


def with_ahead(rows: DataFrame, offset: int) -> DataFrame:
    """Add ahead: the rank at ``offset`` anchors further on in the text."""
    there = Window.partitionBy("node").orderBy("ord").rangeBetween(offset, offset)
    return rows.withColumn("ahead", F.max("rank").over(there))


def doubled(rows: DataFrame, run: int) -> DataFrame:
    """node, ord, id, rank, ahead of the anchors that are tied in all rounds but the last, with the pair for that one; from those of offset 1."""
    now, offset = rows, 1
    while 2 * offset < run and not now.isEmpty():
        offset *= 2
        before, ranks = now.withColumnRenamed("rank", "here"), ranked(now, "rank", "ahead")
        here = ranks.select(F.col("rank").alias("new"), F.col("first").alias("here"), "ahead")
        tied = before.join(here, ["here", "ahead"]).select("node", "ord", "id", F.col("new").alias("rank"))
        then = saved(with_ahead(tied, offset).where("ahead is not null"), "pairs", hashes=True)
        forget(ranks)
        if now is not rows:
            forget(now)
        now = then
    return now


def removed_runs(docs: DataFrame, *, text: str = "text", length: int = 400, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """(nodes with n copies; node, first, last: starts of repeated strings) for the distinct texts (md5)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    source = docs.select(F.unhex(F.md5(body)).alias("node"), body.alias("data"))
    nodes = saved(source.groupBy("node").agg(F.count("*").alias("copies")), "nodes")

    def texts_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, bytes]]:
        done: set[bytes] = set()
        for b in batches:
            for node, data in zip(b["node"], b["data"]):
                if first_seen(done, bytes(node)):  # copies in the same task
                    yield bytes(node), bytes(data)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for _, data in texts_of(batches):
            for part in anchors(data, length, run):
                yield part[4]

    repeated = lambda rows: spark.sparkContext.broadcast(bit_set(rows.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "key"))
    shared = repeated(source.mapInPandas(lambda it: counted_frames(phrases(it)), "key long, n long"))

    def tied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for node, data in texts_of(batches):
            rows, known = tied_anchors(data, length, run, shared.value)
            if known:
                a, b = np.array(known).T
                held.append((node, [-1 - a, a, b, *[np.zeros(len(a), np.int64)] * (len(ANCHOR) - 3)]))
            if rows:
                held.append((node, list(rows.values())))
            size += len(known) + len(rows.get("ord", ()))
            if size >= 50_000:
                yield anchor_frame(held)
                held, size = [], 0
        if size:
            yield anchor_frame(held)

    def anchor_frame(held: list[tuple]) -> pd.DataFrame:
        nodes, columns = zip(*held)
        return pd.DataFrame({"node": np.repeat(np.array(nodes, object), [len(c[0]) for c in columns])} | dict(zip(ANCHOR, map(np.concatenate, zip(*columns)))))

    made = source.mapInPandas(tied, "node binary, ord int, first int, last int, " + ", ".join(f"{c} long" for c in ANCHOR[3:]))
    # copies of a text in different tasks count once; a text's anchors stay together for the rounds
    made = made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").dropDuplicates(["node", "ord"])
    made = saved(made.withColumn("id", F.monotonically_increasing_id()), "anchors", hashes=True)
    known = made.where("ord < 0").select("node", "first", "last")
    begin = made.where("ord >= 0").select("node", "ord", "id", "rank", "ahead")
    pairs = doubled(begin, run)
    said = made.where("ord >= 0 and last >= first").select("id", "node", "first", "last", "core", "s0", "s1")
    tied_rows = saved(pairs.select("id", "rank", "ahead").join(said, "id"), "tied", hashes=True)
    if pairs is not begin:
        forget(pairs)
    last_pair, strings_of = ["rank", "ahead", "core"], ["s0", "s1"]
    kinds = saved(tied_rows.groupBy(*last_pair, *strings_of).agg(F.count("*").alias("n"), F.min("id").alias("id")), "kinds")
    mixed = kinds.groupBy(*last_pair).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*last_pair)
    equal = tied_rows.join(kinds.where("n > 1").select(*strings_of), strings_of, "left_semi").select("node", "first", "last")
    one = kinds.join(mixed, last_pair, "left_semi").select("id", (F.col("n") == 1).alias("asked"))
    open_ = tied_rows.join(one, "id").select("node", "first", "last", "asked")
    open_ = saved(open_.groupBy("node").agg(F.collect_list(F.struct("first", "last", "asked")).alias("parts")), "open")  # at most a text's own anchors
    wanted = spark.sparkContext.broadcast(bit_set(open_.select(F.xxhash64("node").alias("h")), "h", 23))

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[bytes] = set()
        for b in batches:
            b = b[in_set(wanted.value, b["h"].to_numpy())]
            b = b[np.array([first_seen(done, bytes(n)) for n in b["node"]], bool)]
            yield b[["node", "data"]]

    texts = source.withColumn("h", F.xxhash64("node")).mapInPandas(needed, "node binary, data binary").join(open_, "node")
    texts = saved(texts.groupBy("node").agg(F.first("data").alias("data"), F.first("parts").alias("parts")), "texts")

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for b in batches:
            for data, parts in zip(b["data"], b["parts"]):
                for _, h, _ in open_strings(data, parts, length):
                    yield h

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for node, data, parts in zip(b["node"], b["data"], b["parts"]):
                for s, h, asked in open_strings(data, parts, length):
                    ok = in_set(likely.value, h)
                    if ok.any():
                        held.append((node, digests(data, s[ok], s[ok] + length), s[ok], asked[ok]))
                        size += int(ok.sum())
                    if size >= 50_000:
                        yield found_frame(held)
                        held, size = [], 0
        if held:
            yield found_frame(held)

    def found_frame(held: list[tuple]) -> pd.DataFrame:
        nodes, two, s, asked = zip(*held)
        two = np.concatenate(two)
        return pd.DataFrame({"node": np.repeat(np.array(nodes, object), list(map(len, s))), "s0": two[:, 0], "s1": two[:, 1], "first": np.concatenate(s), "asked": np.concatenate(asked)})

    likely = repeated(texts.mapInPandas(lambda it: counted_frames(hashes(it)), "key long, n long"))
    found = saved(texts.mapInPandas(strings, "node binary, s0 long, s1 long, first int, asked boolean"), "strings")
    ranks = ranked(found, *strings_of).select(F.col("first").alias("s0"), "s1")
    some = found.where("asked").join(ranks, strings_of).select("node", "first", F.col("first").alias("last"))
    return nodes, known.union(equal).union(some)


def cut(data: bytes, runs: list, copies: int, length: int) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs, bytes kept."""
    n = len(data)
    if copies > 1 and n >= length:
        return n, 1, b""
    if not len(runs):
        return 0, 0, data
    edge = np.zeros(n + 1, np.int32)
    first, last = np.array([r["first"] for r in runs]), np.array([r["last"] for r in runs])
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return int(gone.sum()), int(gone[0]) + int((np.diff(gone.astype(np.int8)) == 1).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()


def _with_runs(docs: DataFrame, text: str, length: int, run: int) -> tuple[DataFrame, DataFrame]:
    """docs' rows whose text may lose bytes, with ``_runs`` and ``_copies`` or nulls; the others, which need neither a shuffle nor a second Python worker in their task."""
    nodes, runs = removed_runs(docs, text=text, length=length, run=run)
    per = runs.groupBy("node").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))  # at most a text's own starts
    per = saved(per.join(nodes.where("copies > 1"), "node", "full").select(F.col("node").alias("_node"), "_runs", F.coalesce("copies", F.lit(1)).alias("_copies")), "runs")
    node = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(per.select(F.xxhash64("_node").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def likely(h: pd.Series) -> pd.Series:
        return pd.Series(in_set(bits.value, h.to_numpy()))

    rows = docs.withColumn("_node", node).withColumn("_likely", likely(F.xxhash64("_node")))
    joined = rows.where("_likely").join(per, "_node", "left")
    return joined.drop("_node", "_likely"), rows.where("not _likely").drop("_node", "_likely")


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 400, run: int = RUN) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 for every row."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, runs, copies in zip(b["text"], b["_runs"], b["_copies"]):
                data = t.encode("utf-8", "surrogatepass")
                lost, spans, kept = cut(data, runs if runs is not None else (), int(copies), length)
                out.append((len(data), lost, spans, hashlib.sha256(kept).hexdigest()))
            yield pd.concat([b[["key"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])], axis=1)

    source = docs.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows, others = _with_runs(source, "text", length, run)
    rows = rows.withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    done = rows.select("key", "text", "_runs", "_copies").mapInPandas(told, "key string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("bigint")
    rest = others.select("key", F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return done.unionByName(rest).withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)


def cleaned(docs: DataFrame, *, text: str = "text", length: int = 400, run: int = RUN) -> DataFrame:
    """docs with each text cut down to the bytes that stay (broken characters at a cut are dropped); other columns stay.

    The cut is marked as not deterministic, so that a filter on the new text isn't moved below it, which would cut each text twice, by two Python workers a task.
    """

    @F.pandas_udf("string")
    def kept(texts: pd.Series, runs: pd.Series, copies: pd.Series) -> pd.Series:
        return pd.Series([cut(t.encode("utf-8", "surrogatepass"), r if r is not None else (), int(c), length)[2].decode("utf-8", "ignore") for t, r, c in zip(texts, runs, copies)])

    rows, others = _with_runs(docs, text, length, run)
    touched = F.col(text).isNotNull() & (F.col("_runs").isNotNull() | (F.col("_copies") > 1))
    new = kept.asNondeterministic()(F.coalesce(F.col(text).cast("string"), F.lit("")), F.col("_runs"), F.coalesce("_copies", F.lit(1)))
    return rows.withColumn(text, F.when(touched, new).otherwise(F.col(text))).select(*docs.columns).union(others.select(*docs.columns))
