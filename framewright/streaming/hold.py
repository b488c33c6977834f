"""Streaming: stale filter and rates over event-time windows, and a stateful last value per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATEST = "episode_index long, feature_key string, ts_ns long, value double, n long"


def windowed_rates(messages: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Messages and mean value of each topic and window; rows later than the watermark are left out."""
    m = messages.withWatermark(ts, late)
    return m.groupBy(F.window(ts, width).alias("w"), "topic").agg(F.count("*").alias("n_messages"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "topic", "n_messages", "mean")


def latest(samples: DataFrame) -> DataFrame:
    """The held sample of each (episode, key) after every batch: what a frame at that moment would take."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, value, n = state.get if state.exists else (-(2**63), None, 0)
        for p in parts:
            n += len(p)
            best = p.sort_values(["ts_ns", "seq"]).iloc[-1]
            if int(best.ts_ns) >= ts:
                ts, value = int(best.ts_ns), float(best.value)
        state.update((ts, value, n))
        yield pd.DataFrame({"episode_index": [key[0]], "feature_key": [key[1]], "ts_ns": [ts], "value": [value], "n": [n]})

    return samples.groupBy("episode_index", "feature_key").applyInPandasWithState(step, LATEST, "ts_ns long, value double, n long", "update", GroupStateTimeout.NoTimeout)
