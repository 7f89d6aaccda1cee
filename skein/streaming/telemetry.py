"""Telemetry streams (ts, event_type, value): windowed statistics, sessions of quiet and a smoothed rate."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Counts and means by type and window; rows later than the watermark are dropped by it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("avg_value")).select(F.col("w.start").alias("start"), "event_type", "n", "avg_value")


def debounced(events: DataFrame, quiet: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row for each burst: a burst ends when nothing comes for `quiet`."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def smoothed(events: DataFrame, weight: float = 0.6) -> DataFrame:
    """event_type, n, rate after each batch: weight * value + (1 - weight) * the rate before, in the order of ts within a
    batch. The state is two numbers a key."""

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        n, rate = state.get if state.exists else (0, 0.0)
        for v in pd.concat(list(frames)).sort_values("ts")["value"].dropna():
            n, rate = n + 1, float(v) if n == 0 else weight * float(v) + (1 - weight) * rate
        state.update((n, rate))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "rate": [rate]})

    return events.groupBy("event_type").applyInPandasWithState(run, "event_type string, n long, rate double", "n long, rate double", "update", GroupStateTimeout.NoTimeout)
