"""Seeded synthetic recordings: event times, waveforms laid over each other, noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.events import refractory
from eventloom.operators.series import add_noise


def _uniform(*parts) -> Column:
    """A number in (0, 1) that depends on its parts only, so retries repeat it."""
    return (F.pmod(F.xxhash64(*(F.col(p) if isinstance(p, str) else p for p in parts)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def event_times(spark: SparkSession, units: int, samples: int, samplerate: float, rate: tuple[float, float] = (0.5, 3.0), period: float = 20.0, channels: int = 4, seed: int = 0, recording: str = "synthetic") -> DataFrame:
    """firings_true: event_id, recording_id, channel, time, label, amplitude (a scale). Rates rise over the
    units from rate[0] to rate[1] per second; events closer than ``period`` samples to the last kept are left out."""
    per = F.round(samples / samplerate * (rate[0] + (rate[1] - rate[0]) * (F.col("label") - 1) / max(1, units - 1))).cast("int")
    unit = spark.range(1, units + 1).select(F.col("id").cast("int").alias("label"))
    each = unit.select("label", F.explode(F.sequence(F.lit(1), F.greatest(per, F.lit(1)))).alias("i"))
    rows = each.select(
        (F.col("label").cast("bigint") * 10_000_000 + F.col("i")).alias("event_id"), F.lit(recording).alias("recording_id"), (F.col("label") % channels + 1).alias("channel"),
        F.floor(_uniform(F.lit(seed), "label", "i") * samples).cast("double").alias("time"), "label", (1 + 0.2 * (_uniform(F.lit(seed + 1), "label", "i") - 0.5)).alias("amplitude"),
    )
    return refractory(rows, period)


def waveforms(spark: SparkSession, units: int, channels: int, clip_size: int, seed: int = 0, height: float = 20.0) -> DataFrame:
    """label, channel, dt, value: a damped wave per unit, strongest on its own channel."""
    grid = spark.range(units * channels * clip_size).select((F.expr(f"id div {channels * clip_size}") + 1).cast("int").alias("label"), (F.expr(f"(id div {clip_size}) % {channels}") + 1).cast("int").alias("channel"), (F.col("id") % clip_size).cast("int").alias("dt"))
    mid = (clip_size + 1) // 2 - 1
    home = F.col("label") % channels + 1
    far = F.exp(-0.7 * F.abs(F.col("channel") - home))
    width = 2 + 4 * _uniform(F.lit(seed), "label")
    phase = 2 * math.pi * _uniform(F.lit(seed + 1), "label", "channel")
    x = (F.col("dt") - mid) / width
    return grid.select("label", "channel", "dt", (-height * far * F.exp(-x * x / 2) * F.cos(x + 0.5 * F.sin(phase))).alias("value"))


def superpose(firings: DataFrame, shapes: DataFrame, samples: int, clip_size: int, channels: int) -> DataFrame:
    """recording_id, channel, t, value of every sample: the sum of all events' scaled waveforms."""
    mid = (clip_size + 1) // 2 - 1
    laid = firings.select("recording_id", "time", "label", F.col("amplitude").alias("scale")).join(shapes, "label")
    sums = laid.groupBy("recording_id", "channel", (F.col("time").cast("bigint") - mid + F.col("dt")).alias("t")).agg(F.sum(F.col("scale") * F.col("value")).alias("value"))
    grid = firings.select("recording_id").distinct().select("recording_id", F.explode(F.sequence(F.lit(1), F.lit(channels))).alias("channel")).select("recording_id", "channel", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint"))).alias("t"))
    return grid.join(sums, ["recording_id", "channel", "t"], "left").select("recording_id", "channel", "t", F.coalesce("value", F.lit(0.0)).alias("value"))


def synthesize(spark: SparkSession, units: int = 6, channels: int = 4, samples: int = 60_000, samplerate: float = 30_000.0, clip_size: int = 40, noise_level: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(timeseries, firings_true)."""
    firings = event_times(spark, units, samples, samplerate, channels=channels, seed=seed, rate=(5.0, 20.0))
    series = superpose(firings, waveforms(spark, units, channels, clip_size, seed), samples, clip_size, channels)
    return add_noise(series, noise_level, seed), firings
