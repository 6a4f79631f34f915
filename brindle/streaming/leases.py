"""Leases and retries of articles as a stateful stream with timers.

Events tell that an article was found, claimed for a stage, done with it, or failed. A claim is a lease: if neither done nor
failed comes before it is over, a timer puts the article back, without any event. Time is event time, so a replay of the same
events gives the same states. Finished articles are forgotten some time later, by a timer as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from brindle.operators.pipeline import MOST_RETRIES, STAGE_INPUT, STAGE_OUTPUT

EVENTS = "id long, kind string, stage string, at timestamp"
STATES = "id long, at timestamp, event string, status string, retry_count int"
#: Timers need a state store with many keys on disk.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FINISHED = ("analyzed", "failed")


def after(status: str | None, stage: str | None, retries: int, kind: str, asked: str | None, most: int = MOST_RETRIES) -> tuple[str | None, str | None, int] | None:
    """(status, stage of the lease, retries) after an event, or None if it isn't allowed: a claim in the wrong state, of a leased article or without retries left, and an end without a lease."""
    if kind == "found":
        return ("new", None, 0) if status is None else None
    if kind == "claimed":
        free = status is not None and stage is None and retries < most and status in STAGE_INPUT.get(asked, ())
        return (status, asked, retries) if free else None
    if stage is None or asked != stage:
        return None
    if kind == "done":
        return STAGE_OUTPUT[stage], None, 0
    if kind == "failed":
        return ("failed" if retries + 1 >= most else STAGE_INPUT[stage][0]), None, retries + 1
    return None


class Leases(StatefulProcessor):
    """The state of an article: its status, the stage that holds it, retries, and when its timer is due."""

    def __init__(self, lease_minutes: int, keep_minutes: int, most: int) -> None:
        self.lease, self.keep, self.most = 60_000 * lease_minutes, 60_000 * keep_minutes, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("article", "status string, stage string, retries int, due long")

    def _put(self, status: str | None, stage: str | None, retries: int, due: int, old: int) -> None:
        if old > 0 and old != due:
            self.handle.deleteTimer(old)
        if due > 0 and old != due:
            self.handle.registerTimer(due)
        self.known.update((status, stage, retries, due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable")  # one article's events of a batch
        status, stage, retries, due = self.known.get() if self.known.exists() else (None, None, 0, 0)
        out, old = [], due
        for kind, asked, at in zip(frame["kind"], frame["stage"], frame["at"], strict=True):
            now = int(at.timestamp() * 1000)
            if stage is not None and due <= now:  # the lease was over before this event; the timer would say so a little later
                out.append((key[0], pd.Timestamp(due, unit="ms"), "lease over", status, retries))
                stage, due = None, 0
            new = after(status, stage, retries, kind, asked, self.most)
            if new is not None:
                status, stage, retries = new
                due = now + self.lease if stage is not None else now + self.keep if status in FINISHED else 0
            out.append((key[0], at, kind if new is not None else f"{kind} refused", status, retries))
        if status is not None:
            self._put(status, stage, retries, due, old)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, stage, retries, due = self.known.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if due != at:
            return
        if stage is None:
            self.known.clear()
            return
        self.known.update((status, None, retries, 0))
        yield self._frame([(key[0], pd.Timestamp(at, unit="ms"), "lease over", status, retries)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["id", "at", "event", "status", "retry_count"]).astype({"retry_count": "int32"})

    def close(self) -> None:
        pass


def lease_states(events: DataFrame, lease_minutes: int = 5, keep_minutes: int = 60 * 24 * 7, late: str = "1 minute", most: int = MOST_RETRIES) -> DataFrame:
    """A stream of STATES, one row for each event and each lease that ran out, of a stream of EVENTS; the session needs the settings of STORE."""
    timed = events.where("id is not null and kind is not null and at is not null").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("id").transformWithStateInPandas(Leases(lease_minutes, keep_minutes, most), STATES, "Update", "EventTime")
