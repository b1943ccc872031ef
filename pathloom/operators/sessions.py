"""From logs to sessions, histories and samples: windows over one partitioning by user."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathloom.functions.numbering import numbered, range_of

USER_TIME = ("timestamp", "item_id", "row_id")


def known_items(log: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose item has a node."""
    return log.join(items.select("item_id").distinct(), "item_id", "left_semi").select(*log.columns)


def with_nodes(log: DataFrame, items: DataFrame) -> DataFrame:
    """Known rows with their node; filter and lookup are one inner join, broadcast where Spark finds the map small."""
    return log.join(items, "item_id").select(*log.columns, "node_id")


def ordered(log: DataFrame) -> DataFrame:
    """Add ``order``: the row's 0-based place by user, time, item and row id over the whole log.

    A user's place inside the user comes from a window, the users' offsets from the counts of ranges of users, so no task
    holds the whole log.
    """
    ranges = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = log.groupBy("user_id").agg(F.count("*").alias("n"))
    quantiles = counts.agg(F.percentile_approx("user_id", [i / ranges for i in range(1, ranges)] or [0.5], 10000).alias("q")).first()["q"] or []
    counts = counts.withColumn("range", range_of(F.col("user_id"), quantiles))
    by_range = counts.groupBy("range").agg(F.sum("n").alias("n"))  # at most ``ranges`` + 1 rows
    start = by_range.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy("user_id")) - F.col("n")
    offsets = counts.withColumn("inside", inside).join(F.broadcast(start), "range").select("user_id", (F.col("start") + F.col("inside")).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*USER_TIME)) - 1
    return log.withColumn("rank", rank).join(offsets, "user_id").withColumn("order", (F.col("rank") + F.col("offset")).cast("bigint")).select(*log.columns, "order")


def concurrent(log: DataFrame) -> DataFrame:
    """Rows that share user and time with another, with the group's size."""
    n = F.count("*").over(Window.partitionBy("user_id", "timestamp"))
    return log.withColumn("n_same", n).where("n_same > 1")


def concurrent_groups(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", "timestamp").agg(F.count("*").alias("n_same")).where("n_same > 1")


def sessions(mapped: DataFrame, parts: int | None = None) -> DataFrame:
    """Runs of equal nodes in a user's order: user_id, session_id, node_id, avg_score, timestamp, n_items. ``parts``: tasks among which the users are dealt."""
    mapped = mapped.repartition(parts, "user_id") if parts else mapped
    w = Window.partitionBy("user_id").orderBy(*USER_TIME)
    new = (~F.col("node_id").eqNullSafe(F.lag("node_id").over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = mapped.withColumn("new", new).withColumn("session_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy("user_id", "session_id").agg(
        F.first("node_id").alias("node_id"), F.avg("is_correct").alias("avg_score"), F.min("timestamp").alias("timestamp"), F.count("*").alias("n_items")
    ).select("user_id", "session_id", "node_id", "avg_score", "timestamp", "n_items")


def samples(found: DataFrame) -> DataFrame:
    """user_id, session_id, history (all earlier sessions, in order), target_node, label.

    A history is as long as the user's past, by definition; consumers that need only its size or latest scores take
    ``history_length`` and ``latest_features``, which don't build it.
    """
    w = Window.partitionBy("user_id").orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)
    history = F.collect_list(F.struct("node_id", "avg_score")).over(w)
    return found.select("user_id", "session_id", history.alias("history"), F.col("node_id").alias("target_node"), F.col("avg_score").alias("label"))


def history_length(found: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("session_id")) - 1
    return found.select("user_id", "session_id", F.col("node_id").alias("target_node"), n.cast("bigint").alias("history_len"))


def latest_features(sampled: DataFrame) -> DataFrame:
    """Sparse features of each sample: the latest score of each node in the history (later sessions overwrite). For samples at hand; see ``latest_scores``."""
    at = sampled.select("user_id", "session_id", F.posexplode("history").alias("pos", "h"))
    return at.groupBy("user_id", "session_id", F.col("h.node_id").alias("node_id")).agg(F.max_by("h.avg_score", "pos").alias("latest_score"))


def latest_scores(found: DataFrame) -> DataFrame:
    """What ``latest_features`` gives, straight from the sessions and without histories.

    A node's score holds from the session after it to the node's next one, so each session gives a run of rows; the work is as large as the result.
    """
    last = F.max("session_id").over(Window.partitionBy("user_id"))
    until = F.coalesce(F.lead("session_id").over(Window.partitionBy("user_id", "node_id").orderBy("session_id")), last)
    runs = found.select("user_id", "node_id", F.col("avg_score").alias("latest_score"), (F.col("session_id") + 1).alias("since"), until.alias("until")).where("until >= since")
    return runs.select("user_id", F.explode(F.sequence("since", "until")).alias("session_id"), "node_id", "latest_score")


def history_text(sampled: DataFrame) -> DataFrame:
    """Samples with the history as text: node:score in ten thousandths, in order."""
    said = F.transform("history", lambda h: F.concat_ws(":", h["node_id"].cast("string"), F.round(h["avg_score"] * 10000).cast("bigint").cast("string")))
    return sampled.withColumn("history", F.array_join(said, " "))


def first_samples(sampled: DataFrame, k: int = 3) -> DataFrame:
    """The first k samples by user and session, to look at."""
    return sampled.orderBy("user_id", "session_id").limit(k)


def few_shot(sampled: DataFrame, k: int | None) -> DataFrame:
    """The first k samples of each target, in sample order; all for None."""
    if k is None:
        return sampled
    rank = F.row_number().over(Window.partitionBy("target_node").orderBy("user_id", "session_id"))
    return sampled.withColumn("shot", rank).where(F.col("shot") <= k)


def on_graph(sampled: DataFrame, nodes: DataFrame) -> DataFrame:
    """Samples whose target is a node."""
    return sampled.join(nodes.select(F.col("node_id").alias("target_node")), "target_node", "left_semi").select(*sampled.columns)


def batches(sampled: DataFrame, size: int, seed: int) -> DataFrame:
    """A shuffled batch number for each sample: in the order of a hash of seed, user and session, batches hold exactly ``size`` samples, the last the rest."""
    key = F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string"), F.col("session_id").cast("string"))
    rows = sampled.withColumn("_at", F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint"))
    return numbered(rows, "_place", "_at", "user_id", "session_id").withColumn("batch", F.floor(F.col("_place") / size)).drop("_at", "_place")


def mastery(found: DataFrame, runs: int = 3, least: float = 0.8) -> DataFrame:
    """Extension: nodes whose last ``runs`` sessions all scored ``least`` or more, at each session."""
    w = Window.partitionBy("user_id", "node_id").orderBy("session_id").rowsBetween(-(runs - 1), 0)
    return found.withColumn("mastered", (F.min("avg_score").over(w) >= least) & (F.count("*").over(w) == runs))


def mastered_nodes(found: DataFrame, runs: int = 3, least: float = 0.8) -> DataFrame:
    """user_id, node_id, since: the nodes that a user ever mastered, and the first session by which."""
    done = mastery(found, runs, least).where("mastered")
    return done.groupBy("user_id", "node_id").agg(F.min("session_id").alias("since"))


def featured(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """user_id, session_id, target_node, target_idx (null outside the graph), label, features: array of (idx, score), the latest score of each node seen before.

    The sessions are sorted by user once, and a task reads them as a stream with the open user's scores in memory, so that no row is made for a (session, node).
    """
    rows = found.join(nodes.select("node_id", "idx"), "node_id", "left").select("user_id", "session_id", F.col("node_id").alias("target_node"), F.col("idx").alias("target_idx"), F.col("avg_score").alias("label"))
    sorted_ = rows.repartition("user_id").sortWithinPartitions("user_id", "session_id")
    made = StructType.fromDDL("features array<struct<idx: bigint, score: double>>").fields
    return sorted_.mapInArrow(with_latest, StructType(rows.schema.fields + made))


def with_latest(batches: Iterator[pa.RecordBatch], cells: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Add the features to rows sorted by user and session; at most ``cells`` (row, node) are at hand, or one row's. A null user has none."""
    user, held, scores = None, np.zeros(0, np.int64), np.zeros(0)  # the open user's nodes, ascending
    for whole in batches:
        at = 0
        while at < len(whole):
            b = whole.slice(at, max(1, int(((len(held) ** 2 + 4 * cells) ** 0.5 - len(held)) / 2)))
            at += len(b)
            users, n = b.column("user_id"), len(b)
            code = users.dictionary_encode(null_encoding="encode").indices.to_numpy()
            group = np.cumsum(np.append(0, code[1:] != code[:-1]))
            ends = np.append(np.flatnonzero(np.diff(group)), n - 1)
            if users[0].as_py() != user:
                held, scores = held[:0], scores[:0]
            nodes = b.column("target_idx")
            ok = np.flatnonzero((nodes.is_valid().to_numpy(zero_copy_only=False)) & users.is_valid().to_numpy(zero_copy_only=False))
            place, owner = np.append(np.full(len(held), -1), ok), np.append(np.zeros(len(held), np.int64), group[ok])
            node = np.append(held, nodes.fill_null(-1).to_numpy()[ok])
            score = np.append(scores, b.column("label").to_numpy(zero_copy_only=False)[ok])
            order = np.lexsort((place, node, owner))
            place, owner, node, score = place[order], owner[order], node[order], score[order]
            # a score holds from the row after it to the node's next one, or to the user's last row
            followed = np.append((owner[1:] == owner[:-1]) & (node[1:] == node[:-1]), False)[: len(node)]
            until = np.where(followed, np.append(place[1:], 0)[: len(node)], ends[owner])
            count = until - place
            row = np.repeat(place + 1, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at_row = np.argsort(row, kind="stable")
            source = np.repeat(np.arange(len(node)), count)[at_row]
            starts = np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(node[source]), pa.array(score[source], from_pandas=True)], ["idx", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(starts), entries)], [*b.schema.names, "features"])
            last = (owner == group[-1]) & ~followed
            user, held, scores = users[n - 1].as_py(), node[last], score[last]


def dense(data: DataFrame, n_nodes: int) -> DataFrame:
    """data with mask and score, arrays of ``n_nodes`` numbers: 1 for nodes seen, and their latest scores, 0 elsewhere."""
    known = F.map_from_entries("features")
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(n_nodes - 1).cast("bigint"))
    rows = data.withColumn("_known", known)
    at = lambda i: F.try_element_at("_known", i)
    rows = rows.withColumns({"mask": F.transform(places, lambda i: at(i).isNotNull().cast("double")), "score": F.transform(places, lambda i: F.coalesce(at(i), F.lit(0.0)))})
    return rows.drop("_known", "features")
