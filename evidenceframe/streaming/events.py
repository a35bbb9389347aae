"""Stage events as streams: slow stages, windowed counts, throttling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..settings import DEFAULTS


def slow_stages(events: DataFrame, latency: str = "latency_ms", limit: float = DEFAULTS.slow_ms) -> DataFrame:
    """Events at or above the limit; works on streams and tables."""
    return events.where(F.col(latency) >= limit)


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and their total value by window and type; late rows within the watermark count."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def throttled(events: DataFrame, interval_ms: int = 150) -> DataFrame:
    """Of each user's events (user_id, ts), those at least ``interval_ms`` after the last emitted one."""

    def emit(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        for frame in frames:
            rows = []
            for ts in sorted(frame["ts"]):
                now = int(pd.Timestamp(ts).value // 1_000_000)
                if last is None or now - last >= interval_ms:
                    last = now
                    rows.append((key[0], ts))
            if rows:
                yield pd.DataFrame(rows, columns=["user_id", "ts"])
        if last is not None:
            state.update((last,))

    return events.select("user_id", "ts").groupBy("user_id").applyInPandasWithState(
        emit, "user_id long, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout
    )
