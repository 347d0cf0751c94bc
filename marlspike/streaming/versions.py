"""Change versions with state: each key's accepted changes are counted, a burst fires when its key has been quiet for a gap.

The state of a key is its version and the time of its last change; a timer stands at that time plus the gap. A fired burst
tells the version that it covers, so a run that starts from it covers every change up to that version and none is lost: a
later change raises the version and fires again.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

FIRED = "key string, change_version long, n long, began timestamp, fires timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bursts(StatefulProcessor):
    """Rows (key, ts) to FIRED. Changes of one batch are taken in the order of their time."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("burst", "version long, n long, began long, last long")  # milliseconds; n 0: no open burst

    def _fired(self, key, version: int, n: int, began: int, last: int) -> tuple:
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        return (key[0], version, n, at(began), at(last + self.gap))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, n, began, last = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        out = []
        for at in sorted(int(t) for pdf in rows for t in pdf["ms"]):
            if n and at - last > self.gap:  # as session windows, a change just at the end joins
                out.append(self._fired(key, version, n, began, last))
                n = 0
            began = min(began, at) if n else at
            version, n, last = version + 1, n + 1, max(at, last) if n else at
        self.state.update((version, n, began, last))
        if n:
            self.handle.registerTimer(last + self.gap)
        if out:
            yield pd.DataFrame(out, columns=["key", "change_version", "n", "began", "fires"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, n, began, last = self.state.get()
        if n:
            self.state.update((version, 0, began, last))
            yield pd.DataFrame([self._fired(key, version, n, began, last)], columns=["key", "change_version", "n", "began", "fires"])

    def close(self) -> None:
        pass


def fired(events: DataFrame, key: str, ts: str, gap_ms: int, late: str) -> DataFrame:
    """The bursts of a stream of changes: FIRED. late: how far out of order changes may come (the watermark)."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("ms")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Bursts(gap_ms), outputStructType=FIRED, outputMode="append", timeMode="eventTime")


def fired_batch(events: DataFrame, key: str, ts: str, gap_ms: int) -> DataFrame:
    """The same of a table: session windows, and the versions as the running sums of their counts."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"))
    own = rows.groupBy("key", F.session_window("ts", f"{gap_ms} milliseconds").alias("w")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("key").orderBy("w.start").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("key", F.sum("n").over(order).alias("change_version"), "n", F.col("w.start").alias("began"), F.col("w.end").alias("fires"))


class Barrier:
    """Waits for versions: `done` is told each version that a sink has worked off."""

    def __init__(self):
        self.reached: dict[str, int] = {}

    def done(self, batch: DataFrame) -> None:
        """The largest version by key of a batch of FIRED (a row a key; keys are projects)."""
        for r in batch.groupBy("key").agg(F.max("change_version").alias("v")).collect():
            self.reached[r.key] = max(self.reached.get(r.key, 0), r.v)

    def flush(self, query, key: str, version: int, seconds: float = 60.0) -> None:
        """Returns when `version` of the key has been worked off; an error of the query surfaces here."""
        end = time.monotonic() + seconds
        while self.reached.get(key, 0) < version:
            if query.exception() is not None:
                raise query.exception()
            if not query.isActive or time.monotonic() > end:
                raise TimeoutError(f"version {version} of {key} is not reached")
            query.processAllAvailable()
            time.sleep(0.05)
