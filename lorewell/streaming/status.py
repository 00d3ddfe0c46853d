"""Status machines as state of a stream: each node's last status is kept between micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Columns that a stream of statuses has, and those of what doesn't follow.
EVENTS = "node long, seq long, status string, correction boolean"
VIOLATIONS = "node long, seq long, before string, status string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: Groups by the hash of the node, each with one state; a checkpoint holds this number.
BUCKETS = 1024
STATE = "nodes array<long>, seqs array<long>, statuses array<string>, heard array<long>"
_HELD = ["node", "seq", "status", "heard"]


class StatusMachine(StatefulProcessor):
    """Tells the events of a node whose status doesn't follow from its last one, corrections aside.

    ``edges`` maps a status to the next one. Events of a micro-batch are taken in the order of seq; of
    those before the last one seen, that came too late, nothing is told and the state stays. A node of
    which ``idle_ms`` long nothing is heard is forgotten by a timer (never, if that is None). The nodes
    of a bucket are kept together, so that a micro-batch reads and writes a state for each bucket, not
    for each node, and compares the events of all its nodes at once."""

    def __init__(self, edges: dict[str, str], idle_ms: int | None = None):
        self.edges, self.idle_ms = edges, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def _held(self) -> pd.DataFrame:
        found = self.last.get() if self.last.exists() else ([], [], [], [])
        return pd.DataFrame({c: pd.Series(list(v), dtype=object if c == "status" else "int64") for c, v in zip(_HELD, found)})

    def _keep(self, held: pd.DataFrame) -> None:
        if len(held):
            self.last.update(tuple(held[c].tolist() for c in _HELD))
        else:
            self.last.clear()
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            if len(held):
                self.handle.registerTimer(int(held["heard"].min()) + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events, held = pd.concat(list(rows)), self._held()
        now = 0 if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs()
        every = pd.concat([held.assign(new=False), events[["node", "seq", "status", "correction"]].assign(heard=now, new=True)], ignore_index=True)
        # first a node's last event so far, then its new ones in order; of equal numbers the first counts
        every = every.sort_values(["node", "new", "seq"], kind="stable", ignore_index=True)
        most = every.groupby("node")["seq"].cummax().shift(fill_value=0)
        first = every["node"] != every["node"].shift()
        every = every[first | (every["seq"] > most)].reset_index(drop=True)
        first, before = every["node"] != every["node"].shift(), every["status"].shift()
        corrected = every["correction"].map(lambda c: not pd.isna(c) and bool(c)).astype(bool)
        follows = before.map(self.edges)
        # a status without a next one is followed by none but null
        wrong = ~((follows == every["status"]) | (follows.isna() & every["status"].isna()))
        told = every["new"].astype(bool) & ~first & before.notna() & ~corrected & wrong
        # a node is heard of even by what comes too late
        heard = every["node"].isin(events["node"])
        every["heard"] = every["heard"].where(~heard, now)
        every["status"] = every["status"].astype(object).where(every["status"].notna(), None)
        self._keep(every[every["node"] != every["node"].shift(-1)])
        out = every.assign(before=before)[told]
        yield out[["node", "seq", "before", "status"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self._keep(held[held["heard"] + self.idle_ms > timerValues.getCurrentProcessingTimeInMs()])
        yield pd.DataFrame([], columns=["node", "seq", "before", "status"])

    def close(self) -> None:
        pass


def violations(events: DataFrame, edges: dict[str, str], idle_ms: int | None = None) -> DataFrame:
    """(node, seq, before, status) of a stream of EVENTS; start it within keyed_state()."""
    kept = events.select("node", "seq", "status", "correction").where("node IS NOT NULL AND seq IS NOT NULL")
    mode = "None" if idle_ms is None else "ProcessingTime"
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(StatusMachine(edges, idle_ms), VIOLATIONS, outputMode="Append", timeMode=mode)


@contextmanager
def keyed_state(spark: SparkSession):
    """The store that keyed state needs, for streams that start within; the session's own comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
