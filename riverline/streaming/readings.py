"""Additions for unbounded inputs: windowed station readings and a running maximum with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Readings by line and window; rows later than `late` are dropped by the watermark."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width))
    return g.agg(F.count("*").alias("n"), F.max("value").alias("most")).select("user_id", F.col("window.start").alias("start"), "n", "most")


def running_maximum(events: DataFrame) -> DataFrame:
    """(user_id, most) after each batch that brings a line anything new."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most = state.get[0] if state.exists else float("-inf")
        for f in frames:
            most = max(most, float(f["value"].max()))
        state.update((most,))
        yield pd.DataFrame({"user_id": [key[0]], "most": [most]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, most double", "most double", "update", GroupStateTimeout.NoTimeout)
