"""The prerequisite graph as tables: nodes, edges, cycles, depths, frontiers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.numbering import numbered
from pathloom.functions.scalars import prereq_ratio, tie_break_score
from pathloom.functions.store import saved

#: Levels of a search that one job does.
LEVELS = 4
#: Edges from which the joins of a search broadcast nothing: a search has hundreds of joins, and what each may broadcast adds up on the driver. As each
#: such join sorts, a job then does one level, so that few sorts are open in a task.
LARGE = 100_000


def apart(rows: DataFrame, large: bool) -> DataFrame:
    """A side of a join that is shuffled, not broadcast, if the graph is large."""
    return rows.hint("merge") if large else rows


def nodes(items: DataFrame | None, edges: DataFrame) -> DataFrame:
    """node_id, idx: the union of mapped nodes and edge ends, numbered from 0 by id."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    if items is not None:
        ends = ends.union(items.select("node_id"))
    return numbered(saved(ends.distinct(), "nodes"), "idx", "node_id").select("node_id", "idx")


def mined_edges(mapped: DataFrame, found: DataFrame, most: int = 2, *, easier_first: bool = True) -> DataFrame:
    """src, dst: for each node the ``most`` nodes from which learners most often came to it next, of the easier ones, so that there are no cycles.

    A node is easier if more of its answers were right, the smaller id at ties. Without ``easier_first`` all nodes count, and cycles may stand.
    """
    rate = mapped.groupBy("node_id").agg((F.sum("is_correct") / F.count("*")).alias("rate"))
    before = F.lag("node_id").over(Window.partitionBy("user_id").orderBy("session_id"))
    moves = found.select(before.alias("src"), F.col("node_id").alias("dst")).where("src is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))
    if easier_first:
        a, b = (rate.select(F.col("node_id").alias(x), F.col("rate").alias(f"{x}_rate")) for x in ("src", "dst"))
        moves = moves.join(a, "src").join(b, "dst").where("src_rate > dst_rate or (src_rate = dst_rate and src < dst)")
    best = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("n"), "src"))
    return moves.withColumn("best", best).where(F.col("best") <= most).select("src", "dst")


def edge_index(found: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, src_idx, dst_idx with duplicates kept."""
    a = found.select(F.col("node_id").alias("src"), F.col("idx").alias("src_idx"))
    b = found.select(F.col("node_id").alias("dst"), F.col("idx").alias("dst_idx"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "src_idx", "dst_idx")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.distinct().withColumn("weight", F.lit(1.0))


def roots(found: DataFrame, edges: DataFrame) -> DataFrame:
    return found.join(edges, found["node_id"] == edges["dst"], "left_anti").select("node_id")


def predecessors(found: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, preds (sorted array)."""
    by = edges.distinct().groupBy(F.col("dst").alias("node_id")).agg(F.array_sort(F.collect_list("src")).alias("preds"))
    return found.join(by, "node_id", "left").select("node_id", "idx", F.coalesce("preds", F.array().cast("array<bigint>")).alias("preds"))


def reached(start: DataFrame, step: Callable[[DataFrame], DataFrame], large: bool = False) -> DataFrame:
    """The rows of start and all that ``step`` makes of them, again and again; each row once. LEVELS steps are one job. ``large``: without broadcasts."""
    parts = [saved(start.distinct(), "reached")]
    while True:
        level, found = parts[-1], []
        for _ in range(1 if large else LEVELS):
            level = step(level).select(*start.columns).distinct()
            found.append(level)
        new = reduce(DataFrame.union, found).distinct()
        for part in [apart(reduce(DataFrame.union, parts), True)] if large else parts:
            new = new.join(part, start.columns, "left_anti")
        new = saved(new, "reached")
        if new.isEmpty():
            return reduce(DataFrame.union, parts)
        parts.append(new)
        if len(parts) > 8:
            parts = [saved(reduce(DataFrame.union, parts[:-1]), "reached"), new]


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without incoming or without outgoing edges are peeled away: those of cycles and of paths between cycles."""
    left = saved(edges.distinct(), "edges")
    n = left.count()
    while n:
        now = left
        for _ in range(LEVELS if n <= LARGE else 1):
            ends, starts = (apart(now.select(F.col(a).alias(b)).distinct(), n > LARGE) for a, b in (("dst", "src"), ("src", "dst")))
            now = now.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst")
        left = saved(now, "edges")
        n, before = left.count(), n
        if n == before:
            break
    return left


def components(edges: DataFrame) -> DataFrame:
    """node_id, root for the nodes on cycles: root is the least node of the strongly connected component.

    All nodes learn the least node that reaches them (their colour); a colour's own node and what goes back to it inside the colour is a component. What
    is left is peeled and coloured again.
    """
    left, found = on_cycles(edges), []
    while n := left.count():
        large = n > LARGE
        ends = left.select(F.col("src").alias("node_id")).union(left.select("dst")).distinct()
        colour = saved(ends.withColumn("colour", F.col("node_id")), "colour")
        while True:
            now = colour
            for _ in range(1 if large else LEVELS):
                sent = now.join(apart(left, large), now["node_id"] == left["src"]).select(F.col("dst").alias("node_id"), "colour")
                now = now.union(sent).groupBy("node_id").agg(F.min("colour").alias("colour"))
            now = saved(now, "colour")
            same = now.join(apart(colour, large), ["node_id", "colour"], "left_anti").isEmpty()
            colour = now
            if same:
                break
        a, b = (apart(colour.select(F.col("node_id").alias(x), F.col("colour").alias(f"{x}_colour")), large) for x in ("src", "dst"))
        inside = saved(left.join(a, "src").join(b, "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("root")), "inside")
        start = colour.where("node_id = colour").select("node_id", F.col("colour").alias("root"))
        back = reached(start, lambda level: level.withColumnRenamed("node_id", "dst").join(apart(inside, large), ["dst", "root"]).select(F.col("src").alias("node_id"), "root"), large)  # noqa: B023
        found.append(back)
        done = apart(back.select(F.col("node_id").alias("src")), large)
        left = on_cycles(left.join(done, "src", "left_anti").join(apart(done.withColumnRenamed("src", "dst"), large), "dst", "left_anti").select("src", "dst"))
    if not found:
        return edges.select(F.col("src").alias("node_id"), F.col("src").alias("root")).limit(0)
    rows = saved(reduce(DataFrame.union, found), "components")
    large = rows.count() > LARGE
    loops = edges.where("src = dst").select(F.col("src").alias("node_id"))
    several = rows.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    return rows.join(apart(several, large), "root", "left_semi").union(rows.join(apart(loops, large), "node_id", "left_semi").select("root", "node_id")).select("node_id", "root").distinct()


def cycles(edges: DataFrame, most: int | None = 5) -> DataFrame:
    """cycle: of each strongly connected component (the first ``most`` by least node) a shortest cycle through its least node, the least of these."""
    member = saved(components(edges), "members")
    if most is not None:
        member = member.join(F.broadcast(member.select("root").distinct().orderBy("root").limit(most)), "root", "left_semi").select("node_id", "root")  # ``most`` rows
    a, b = member.select(F.col("node_id").alias("src"), "root"), member.select(F.col("node_id").alias("dst"), F.col("root").alias("to"))
    inside = saved(edges.distinct().join(a, "src").join(b, "dst").where("root = to").select("src", "dst", "root"), "inside")
    at = member.select("root").distinct().select("root", F.col("root").alias("src"), F.array("root").alias("path"))
    seen, closed = None, []
    while True:
        on = saved(at.join(inside, ["root", "src"]).groupBy("root", "dst").agg(F.min("path").alias("path")), "paths")
        closed.append(on.where("dst = root").select("root", "path"))
        ended = reduce(DataFrame.union, closed).select("root")
        new = on.where("dst <> root").join(ended, "root", "left_anti").select("root", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"))
        if seen is not None:
            new = new.join(seen, ["root", "src"], "left_anti")
        at = saved(new.select("root", "src", "path"), "paths")
        if at.isEmpty():
            return reduce(DataFrame.union, closed).select(F.col("path").alias("cycle"))
        visited = at.select("root", "src")
        seen = visited if seen is None else saved(seen.union(visited), "seen")


def check_dag(edges: DataFrame) -> None:
    """Raise for a graph with cycles (a loop at a node is one), naming up to five of them."""
    some = sorted(r["cycle"] for r in cycles(edges).collect())  # five at most
    if some:
        raise ValueError(f"the graph has cycles: {some}")


def depths(found: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, depth: the longest path from a root; nodes on cycles and behind them only have none. LEVELS levels are one job."""
    edges = edges.distinct()
    level = found.join(edges, found["node_id"] == edges["dst"], "left_anti").select("node_id", F.lit(0).cast("bigint").alias("depth"))
    parts, most = [saved(level, "depths")], found.count()
    for at in range(0, most, LEVELS):
        level, batch = parts[-1].where(F.col("depth") == at), []
        for _ in range(LEVELS):
            level = level.join(edges, level["node_id"] == edges["src"]).select(F.col("dst").alias("node_id"), (F.col("depth") + 1).alias("depth")).distinct()
            batch.append(level)
        new = saved(reduce(DataFrame.union, batch), "depths")
        if new.isEmpty():
            break
        parts.append(new)
    rows = reduce(DataFrame.union, parts)
    return rows.groupBy("node_id").agg(F.max("depth").alias("depth"))


def at_depth(found: DataFrame, least: int) -> DataFrame:
    """Nodes of depth ``least`` or more, or of the greatest depth where that is less."""
    deepest = found.agg(F.least(F.max("depth"), F.lit(least)).alias("d"))
    return found.where(F.col("depth") >= deepest.scalar())


def subgraph(found: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The first k nodes by id and the edges among them; prerequisites outside the cut vanish."""
    kept = found.orderBy("node_id").limit(k)
    a, b = kept.select(F.col("node_id").alias("src")), kept.select(F.col("node_id").alias("dst"))
    return kept, edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def normalized(found: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, weight of D^-1/2 (A + I) D^-1/2, with D the out-degree and self-loops, without duplicate edges."""
    loops = found.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    full = edges.select("src", "dst").union(loops).distinct()
    degree = full.groupBy("src").agg(F.count("*").alias("d"))
    return full.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))


def mastered_by_user(sessions: DataFrame) -> DataFrame:
    return sessions.select("user_id", "node_id").distinct()


def frontier(found: DataFrame, edges: DataFrame, mastered: DataFrame, users: DataFrame, *, fallback: bool = True) -> DataFrame:
    """user_id, node_id: unmastered nodes whose prerequisites are all mastered; where there are none, the fallback node.

    Met prerequisites are counted by joining mastered nodes to edges, so the work is mastered nodes x out-degree; a root has one prerequisite, null, which
    every user has. The fallback (graphs with cycles only) is the unmastered node with the best share of mastered prerequisites: one
    of those with any, or else the least unmastered node.
    """
    edges = edges.distinct()
    users, had = users.select("user_id").distinct(), mastered.select("user_id", "node_id").distinct().join(found.select("node_id"), "node_id", "left_semi")
    had = saved(had.select("user_id", "node_id"), "had")
    edges = edges.select("src", "dst").union(roots(found, edges).select(F.lit(None).cast("bigint"), "node_id"))
    total = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("total"))
    have = had.join(users, "user_id", "left_semi").union(users.select("user_id", F.lit(None).cast("bigint")))
    met = have.join(edges, have["node_id"].eqNullSafe(edges["src"])).groupBy("user_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("met"))
    begun = saved(met.join(total, "node_id").join(had, ["user_id", "node_id"], "left_anti").select("user_id", "node_id", "met", "total"), "begun")
    ready = begun.where("met = total").select("user_id", "node_id")
    if not fallback:
        return ready
    lacking = users.join(had.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").where(F.coalesce("n", F.lit(0)) < found.agg(F.count("*")).scalar())
    stuck = saved(lacking.select("user_id").join(ready, "user_id", "left_anti"), "stuck")
    if stuck.isEmpty():
        return ready
    # the least unmastered node is the first whose place is not its rank among the user's mastered ones
    place = found.select("node_id", F.col("idx").alias("place"))
    held = had.join(stuck, "user_id", "left_semi").join(place, "node_id")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("place")) - 1
    gaps = held.withColumn("rank", rank).groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("place") != F.col("rank"), F.col("rank"))), F.count("*")).alias("place"))
    least = stuck.join(gaps, "user_id", "left").select("user_id", F.coalesce("place", F.lit(0)).alias("place")).join(place, "place").select("user_id", "node_id", F.lit(0).alias("met"), F.lit(1).alias("total"))
    some = begun.join(stuck, "user_id", "left_semi").union(least)
    score = F.struct(tie_break_score(prereq_ratio(F.col("met"), F.col("total")), F.col("node_id")).alias("score"), (-F.col("node_id")).alias("least"))
    return ready.union(some.groupBy("user_id").agg(F.max(score).alias("b")).select("user_id", (-F.col("b.least")).alias("node_id")))
