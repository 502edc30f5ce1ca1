"""Users of rooms as keyed state: each user once, and again after being away.

``streams.register_users`` joins each micro-batch with the table of all users.
Here a user of a room is a key of its own with a few bytes of state, so neither
a room nor a batch meets what came before.  Rows of one user are reduced to one
within each Arrow batch before they travel, so a user who sends a third of all
messages is a few rows.

Without ``idle`` state grows with the number of users.  With it, a timeout of
event time forgets a user that long after the last message, once the watermark
has passed that instant; the user counts as new after that.  State comes to the
Python worker with the rows; no state server with a port of its own is started.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.functions import text as tx
from wardline.operators.users import GUEST

USERS = "room string, name string, first_seen long, active boolean, at timestamp"


def _milliseconds(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


def _row(key: tuple, first: int, active: bool, at: pd.Timestamp) -> pd.DataFrame:
    return pd.DataFrame({"room": [key[0]], "name": [key[1]], "first_seen": [first], "active": [active], "at": [at]})


def _user(idle_ms: int | None) -> Callable:
    """State: the first place, and until when (in milliseconds) the user counts as present; -1 is for ever."""

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, until = state.get
            state.remove()
            yield _row(key, first, False, pd.Timestamp(until, unit="ms"))
            return
        rows = [(int(part["first_seen"].min()), part["at"].max()) for part in parts]
        first, last = min(r[0] for r in rows), max(r[1] for r in rows)
        until = -1 if idle_ms is None else _milliseconds(last) + idle_ms
        known = state.get if state.exists else None
        if known is not None:
            until = max(until, known[1])
        state.update((first if known is None else min(first, known[0]), until))
        if idle_ms is not None:  # a row may be older than the watermark that this batch ends with
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if known is None or first < known[0]:
            yield _row(key, first, True, last)

    return work


def _first_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each user of a batch of rows."""
    for part in batches:
        yield part.groupby(["room", "name"], as_index=False, dropna=False).agg(first_seen=("first_seen", "min"), at=("at", "max"))


def stream_room_users(
    stream: DataFrame,
    idle: str | None = None,
    watermark: str = "1 hour",
    room: str = "room",
    seq: str = "seq",
    ts: str | None = "ts",
    name: str = "username",
) -> DataFrame:
    """``(room, name, first_seen, active, at)``: a row when a user is new or turns out to have been there earlier, and,
    with ``idle`` (like "30 minutes"), one that is not active when the user is forgotten.

    Guests, blank names and rows without room or place are left out.  With ``idle``, so are rows without an
    instant and those before the watermark; without it there need be no instant (``ts=None``).  Write it in update mode; ``streams.latest_rows`` gives each user's last row.
    """
    at = F.lit(None) if ts is None else F.col(ts)
    named = stream.select(
        F.col(room).alias("room"), tx.norm_key(F.col(name)).alias("name"), F.col(seq).cast("long").alias("first_seen"), at.cast("timestamp").alias("at")
    )
    named = named.filter("room IS NOT NULL AND first_seen IS NOT NULL").filter((F.col("name") != "") & (F.col("name") != GUEST))
    idle_ms = None if idle is None else round(pd.Timedelta(idle).total_seconds() * 1000)
    named = named if idle is None else named.filter("at IS NOT NULL")
    few = named.mapInPandas(_first_of_batch, "room string, name string, first_seen long, at timestamp")
    if idle is not None:
        few = few.withWatermark("at", watermark)
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return few.groupBy("room", "name").applyInPandasWithState(_user(idle_ms), USERS, "first_seen long, until long", "update", timeout)
