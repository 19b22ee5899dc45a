"""Structured Streaming: counts of events in windows, running scales of channels, and detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """window_start, the keys and n. Works on streams, where rows later than ``delay`` behind the latest are
    not counted, and on tables."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    marked = events.withWatermark(time, delay) if events.isStreaming else events
    return marked.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def running_scale(samples: DataFrame) -> DataFrame:
    """Per channel the number of samples and root mean square so far (update or complete mode)."""
    return samples.groupBy("recording_id", "channel").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def detect_stream(samples: DataFrame, threshold: float, interval: int) -> DataFrame:
    """recording_id, channel, t: greedy peaks of |value| of a stream whose samples arrive in order of t per
    channel. The state of a channel is its last candidate; a peak is emitted as soon as a sample lies more
    than the interval behind it, so the last one of a stream stays open."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, best = state.get if state.exists else (-1, 0.0)
        out = []
        rows = pd.concat(list(batches)).sort_values("t")
        for t, v in zip(rows["t"].tolist(), rows["value"].abs().tolist()):
            if at >= 0 and t - at > interval:
                out.append(at)
                at, best = -1, 0.0
            if v >= threshold and (at < 0 or v > best):
                at, best = t, v
        state.update((at, best))
        yield pd.DataFrame({"recording_id": [key[0]] * len(out), "channel": [key[1]] * len(out), "t": out}).astype({"t": "int64"})

    return samples.groupBy("recording_id", "channel").applyInPandasWithState(step, "recording_id string, channel int, t bigint", "at bigint, best double", "append", GroupStateTimeout.NoTimeout)
