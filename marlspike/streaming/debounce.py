"""Debounced change events, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Milliseconds of quiet that end a burst.
DEFAULT_MS, LEAST_MS, MOST_MS = 300, 100, 60_000


def relevant(events: DataFrame, ignored_prefixes: list[str]) -> DataFrame:
    """Events whose path lies under none of the ignored folders; stateless, so it works on streams."""
    out = events
    for p in ignored_prefixes:
        out = out.where(~(F.col("path").startswith(p) | F.col("path").contains(f"/{p}")))
    return out


def bursts(events: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """key, began, fires, n: a burst fires once its key has been quiet for `gap`. late: watermark, needed for streams."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("began"), F.col("w.end").alias("fires"), "n")


def run_bursts(events: DataFrame, key: str, ts: str, gap: str, sink, checkpoint: str, late: str = "1 hour"):
    """Starts a query that hands each batch of finished bursts to sink(rows, batch_id), reads what is there, and returns it.

    To flush: query.processAllAvailable().
    """
    rows = bursts(events, key, ts, gap, late)
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def versions(events: DataFrame, key: str) -> DataFrame:
    """key, change_version: how many accepted changes each key has seen; in complete mode a flush waits for its number."""
    return events.groupBy(key).agg(F.count("*").alias("change_version"))
