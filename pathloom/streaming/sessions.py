"""Extension: the run-length sessionizer over a stream, with one open session for each user as state.

A session is emitted when the user's next node begins, or when the watermark passes the user's last row by ``idle``, so that the last session of each user comes too
once the stream's time has moved on. Rows of a user that come after later ones of the same user were read can't be put in their place any more: they are
counted in ``n_late`` of the session then open, so that none goes missing unseen.

Users are dealt to groups by a hash. A group's state is one value, the columns of its users' open sessions, and one timer, for the user who is idle first; a call takes all new rows
of a group in array steps, since a call for each user costs far more than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, session_id long, node_id long, avg_score double, timestamp long, n_items long, n_late long"
#: Of each user: number, node, sum and count of the open session (no node and count 0 once it has been emitted), first and last time, late rows.
STATE = {"user_id": "long", "session_id": "long", "node_id": "long", "total": "double", "n": "long", "first": "long", "last": "long", "n_late": "long"}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def emitted(s: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"user_id": s["user_id"], "session_id": s["session_id"], "node_id": s["node_id"], "avg_score": s["total"] / s["n"], "timestamp": s["first"], "n_items": s["n"], "n_late": s["n_late"]})


def advanced(held: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The sessions that new rows close, and the state after them; STATE columns, users ascending in the state."""
    new = new.sort_values(["user_id", "timestamp", "item_id", "row_id"])
    users = np.union1d(held["user_id"].to_numpy(), new["user_id"].to_numpy())
    was = np.isin(users, held["user_id"].to_numpy())
    base, open_, late, last = np.full(len(users), -1), np.zeros(len(users), bool), np.zeros(len(users), np.int64), np.full(len(users), np.iinfo(np.int64).min)
    base[was], open_[was], late[was], last[was] = held["session_id"], held["n"] > 0, held["n_late"], held["last"]
    of = np.searchsorted(users, new["user_id"].to_numpy())
    behind = new["timestamp"].to_numpy() < last[of]
    late += np.bincount(of[behind], minlength=len(users))
    new, of = new[~behind], of[~behind]
    # the open sessions, each as a row before its user's new ones
    first = held[held["n"] > 0]
    owner = np.append(np.flatnonzero(open_), of)
    order = np.argsort(owner, kind="stable")
    join = lambda a, b: np.append(a.to_numpy(), b)[order]
    owner, node = owner[order], join(first["node_id"], new["node_id"].to_numpy())
    total, n = join(first["total"], new["is_correct"].to_numpy(np.float64)), join(first["n"], np.ones(len(new), np.int64))
    begin, end = join(first["first"], new["timestamp"].to_numpy()), join(first["last"], new["timestamp"].to_numpy())
    gap = pd.isna(node)
    kind = np.where(gap, 0, node).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (gap[1:] != gap[:-1])][: len(owner)])
    ends, whose = np.append(starts[1:], len(owner))[: len(starts)] - 1, owner[starts]
    leads = np.r_[True, whose[1:] != whose[:-1]][: len(whose)]
    nth = np.arange(len(whose)) - np.maximum.accumulate(np.where(leads, np.arange(len(whose)), 0))
    runs = pd.DataFrame({
        "user_id": users[whose], "session_id": base[whose] + nth + ~open_[whose], "node_id": node[starts], "total": np.add.reduceat(total, starts) if len(starts) else total,
        "n": np.add.reduceat(n, starts) if len(starts) else n, "first": begin[starts], "last": end[ends], "n_late": np.where(leads, late[whose], 0),
    })
    final = np.append(leads[1:], True)[: len(whose)]
    rest = held[~np.isin(held["user_id"].to_numpy(), users[whose])].assign(n_late=late[np.setdiff1d(np.flatnonzero(was), whose)])  # users with late rows at most
    return runs[~final], pd.concat([x for x in (runs[final], rest) if len(x)] or [held]).sort_values("user_id")


class Sessions(StatefulProcessor):
    def __init__(self, idle_ms: int, unit_ms: int):
        self.idle_ms, self.unit_ms = idle_ms, unit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", ", ".join(f"{c} array<{t}>" for c, t in STATE.items()))

    def _held(self) -> pd.DataFrame:
        columns = self.open.get() if self.open.exists() else [[]] * len(STATE)
        return pd.DataFrame({c: pd.Series(v, dtype="float64" if t == "double" else "Int64" if c == "node_id" else "int64") for (c, t), v in zip(STATE.items(), columns)}).astype({"node_id": object})

    def _keep(self, state: pd.DataFrame) -> None:
        """Hold the state, with a timer for the user who is idle first."""
        self.open.update(tuple([None if pd.isna(v) else int(v) for v in state[c]] if c == "node_id" else state[c].tolist() for c in STATE))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        last = state.loc[state["n"] > 0, "last"]
        if len(last):
            self.handle.registerTimer(int(last.min()) * self.unit_ms + self.idle_ms)

    @staticmethod
    def _said(key: Any, closed: pd.DataFrame) -> pd.DataFrame:
        out = emitted(closed).astype({"node_id": "Int64"})
        return out.assign(user_id=None) if key[0] < 0 else out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).astype({"node_id": "Int64"}).astype({"node_id": object})
        closed, state = advanced(self._held(), new)
        self._keep(state)
        yield self._said(key, closed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self._held()
        until = state["last"] * self.unit_ms + self.idle_ms
        idle = (state["n"] > 0) & ((until <= expiredTimerInfo.getExpiryTimeInMs()) | (until < timerValues.getCurrentWatermarkInMs()))
        # the next row starts a new session, also of the same node
        self._keep(state.assign(node_id=state["node_id"].mask(idle, None), total=state["total"].mask(idle, 0.0), n=state["n"].mask(idle, 0), n_late=state["n_late"].mask(idle, 0)))
        yield self._said(key, state[idle])

    def close(self) -> None:
        pass


def closed_sessions(mapped: DataFrame, *, idle_ms: int, delay: str = "0 seconds", unit_ms: int = 3_600_000, groups: int = 1000) -> DataFrame:
    """A row for each session of a stream of mapped rows whose ``timestamp`` counts ``unit_ms`` milliseconds. Needs the RocksDB state store (STORE).

    ``groups``: groups among which the users are dealt; a null user has a group of its own. A call reads the whole state of a group that has new rows, so a group should hold some hundred users.
    """
    timed = mapped.withColumn("at", F.timestamp_millis(F.col("timestamp") * unit_ms)).withWatermark("at", delay)
    group = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(groups)))  # rows of a null key may come in several calls
    # a null would turn the users of its whole Arrow batch into floats
    return timed.withColumn("group", group).withColumn("user_id", F.coalesce("user_id", F.lit(0).cast("bigint"))).groupBy("group").transformWithStateInPandas(Sessions(idle_ms, unit_ms), OUT, "Append", "EventTime")
