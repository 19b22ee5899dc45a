"""Implausible readings per source, by Kalman filters.

A source's level is a random walk seen through noise. One filter runs forward and one backward over the
readings. A reading whose standardised innovation is too large in both is flagged, and a flagged reading is
withheld from the update, so it cannot pull the level towards itself. Where the innovations, less what the
filter's own update explains, lose their variance over a stretch of readings, the source is stuck.

The noise of the filters is the source's usual spread, so every source is judged by its own behaviour. It is
taken first: provisional filters with the noise of each chunk give a log-scale histogram of the deviations
of good readings from their level, and the histograms of a source's chunks are merged.

Long sources are cut into chunks of the sample index with a margin on both sides, so no task depends on the
length of a source. The margin holds the longest run that can be bad and lets the filters settle before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.runtime import Stages

CHUNK = 1 << 15  # samples of one task's group
LONGEST = 512  # samples: a flagged run up to this long is bad as a whole, a longer one is a new level as a whole
SETTLE = 256  # samples in which a filter settles
STRETCH = 16  # readings of a stuck stretch
STUCK = 0.01  # of the spread: readings of a stuck stretch differ by less
SPIKE = 10.0  # times the spread: a spike is further from the level
FLAG = 7.0  # standardised innovations above are flagged; in units of the spread this is under SPIKE
WALK = 0.01  # variance of a level's step, in units of the noise variance
FIRST = 201  # good readings whose median a filter starts from
BINS = 32  # histogram bins per factor of two
TO_SIGMA = 1.4826  # of a median absolute deviation

_CHUNKS = "recording_id string, channel int, chunk bigint, at array<int>, value array<double>, outside array<boolean>, bin array<bigint>, n array<bigint>"
_FLAGS = "recording_id string, channel int, t bigint, reason string, score double"


_PRIOR = (WALK + math.sqrt(WALK * WALK + 4 * WALK)) / 2  # variance of a level before its reading, in the steady state
GAIN = _PRIOR / (1 + _PRIOR)
BLOCK = 128  # readings predicted at once
_DECAY = (1 - GAIN) ** np.arange(BLOCK)
_UPDATES = np.tril(GAIN * (1 - GAIN) ** (np.arange(BLOCK)[:, None] - 1 - np.arange(BLOCK)[None, :]).clip(0), -1)


def forecast(t: np.ndarray, y: np.ndarray, skip: np.ndarray, noise: float, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of a local-level Kalman filter in its steady state, in the order given, and which readings it
    flags: those whose innovation is over FLAG times its standard deviation.

    Readings to skip, which are judged alone, and flagged ones are withheld from the update. A run of flagged
    readings longer than ``longest`` samples is not bad: the filter starts anew at the run's median, from its
    first reading on. After a gap as long it starts anew too."""
    use = np.flatnonzero(~skip)
    if not len(use):
        return np.zeros(len(y)), np.zeros(len(y), bool)
    z, at = y[use], t[use]
    before, flags = np.empty(len(z) + 1), np.zeros(len(z), bool)
    limit = FLAG * noise * math.sqrt(1 + _PRIOR)
    breaks = np.flatnonzero(np.abs(np.diff(at)) > longest) + 1
    level = 0.0
    for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(z)]):
        level, i, restarted = float(np.median(z[a : min(a + FIRST, b)])), a, -1
        while i < b:
            block = z[i : min(i + BLOCK, b)]
            n = len(block)
            levels = _DECAY[:n] * level + _UPDATES[:n, :n] @ block
            far = np.abs(block - levels) > limit
            f = int(far.argmax()) if far.any() else n
            before[i : i + f] = levels[:f]
            if f:
                level = float(levels[f - 1] + GAIN * (block[f - 1] - levels[f - 1]))
            i += f
            if f == n:
                continue
            end, width = i + 1, 32  # the run goes on to the first reading near the level
            while end < b:
                near = np.abs(z[end : min(end + width, b)] - level) <= limit
                if near.any():
                    end += int(near.argmax())
                    break
                end, width = min(end + width, b), 2 * width
            long = np.abs(at[i:end] - at[i]) > longest
            if long.any() and i != restarted:
                level, restarted = float(np.median(z[i : i + int(long.argmax()) + 1])), i
            else:
                before[i:end], flags[i:end] = level, True
                i = end
    before[len(z)] = level
    levels = before[np.cumsum(~skip) - ~skip]
    out = np.abs(y - levels) > limit
    out[use] = flags
    return levels, out


def _noise(y: np.ndarray) -> float:
    """Robust scale from successive differences, which no drift inflates."""
    if len(y) < 2:
        return 0.0
    d = np.abs(np.diff(y))
    s = TO_SIGMA * float(np.median(d)) / math.sqrt(2)
    return s if s > 0 else 0.886 * float(np.mean(d))


def stuck_ranges(innovations: np.ndarray, levels: np.ndarray, y: np.ndarray, small: float) -> np.ndarray:
    """For each reading the least range (max - min) of a stretch of STRETCH readings that holds it and over
    which the innovations' variance vanishes; infinity where there is none.

    Innovations follow the level's own moves; what is left of their changes without those is the reading's
    new information, whose root mean square over a stuck stretch is under ``small``."""
    out = np.full(len(y), np.inf)
    if len(y) < STRETCH:
        return out
    with np.errstate(invalid="ignore"):
        new = np.abs(np.diff(innovations) + np.diff(levels))
        still = new < small * (1 + 1e-6) + 1e-12 * np.maximum(np.abs(y[1:]), np.abs(y[:-1]))  # the range decides what rounding leaves open
    edges = np.flatnonzero(np.diff(np.concatenate(([0], still.view(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2]):  # y[a..b] brings nothing new at any step
        if b - a + 1 < STRETCH:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(y[a : b + 1], STRETCH)
        ranges = windows.max(axis=1) - windows.min(axis=1)
        padded = np.concatenate((np.full(STRETCH - 1, np.inf), ranges, np.full(STRETCH - 1, np.inf)))
        out[a : b + 1] = np.lib.stride_tricks.sliding_window_view(padded, STRETCH).min(axis=1)
    return out


def analyse(t: np.ndarray, v: np.ndarray, outside: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one chunk with margins, in order of t: the range of the stuck stretch, the level of the good readings
    around, the distance from it as seen from the nearer side, and whether the filters of both directions
    flag the reading."""
    usable = np.isfinite(v) & ~outside
    if noise <= 0 or not usable.any():
        return np.full(len(v), np.inf), np.full(len(v), np.nan), np.full(len(v), np.nan), np.zeros(len(v), bool)
    y = np.where(usable, v, 0.0)
    levels, flags = forecast(t, y, ~usable, noise)
    finite = np.where(np.isfinite(v), v, np.nan)
    ranges = stuck_ranges(finite - levels, levels, finite, STUCK * noise)
    skip = ~usable | (ranges < STUCK * noise)
    if (skip & usable).any():
        levels, flags = forecast(t, y, skip, noise)
    back, again = (x[::-1] for x in forecast(t[::-1], y[::-1], skip[::-1], noise))
    known = usable & ~skip.all()
    deviation = np.where(known, np.minimum(np.abs(y - levels), np.abs(y - back)), np.nan)
    return ranges, (levels + back) / 2, deviation, known & flags & again


def deviations(t: np.ndarray, v: np.ndarray, outside: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-scale bins and counts of the good readings' deviations from their level, over a chunk's own samples."""
    usable = np.isfinite(v) & ~outside
    noise = _noise(v[usable])
    ranges, level, deviation, _ = analyse(t, v, outside, noise)
    with np.errstate(invalid="ignore"):
        good = (t // CHUNK == chunk) & usable & ~(ranges < STUCK * noise) & (deviation <= SPIKE * noise)
        own = np.abs(v[good] - level[good])
    return np.unique(np.floor(np.log2(np.maximum(own, 1e-300)) * BINS).astype(np.int64), return_counts=True)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of a sorted partition, one in memory at a time; repeats of a reading are adjacent."""
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["recording_id", "channel", "chunk", "at", "value", "outside", "bin", "n"]
    held: list[tuple] = []
    key: tuple | None = None

    def close() -> pa.RecordBatch:
        t, v, outside = (np.concatenate(c) for c in zip(*held))
        once = np.concatenate(([True], t[1:] != t[:-1]))
        t, v, outside = t[once], v[once], outside[once]
        rec, channel, chunk = key[1:]
        row = (rec, channel, chunk, (t - chunk * CHUNK).astype(np.int32), v, outside, *deviations(t, v, outside, chunk))
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        rec, g = b.column(1), b.column(0).to_numpy()
        channel, chunk, t, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5))
        outside = b.column(6).to_numpy(zero_copy_only=False).astype(bool)
        cuts = np.flatnonzero((g[1:] != g[:-1]) | (channel[1:] != channel[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]
        for a, z in zip(starts, ends):
            now = (int(g[a]), rec[a].as_py(), int(channel[a]), int(chunk[a]))
            if now != key:
                if key is not None:
                    yield close()
                key, held = now, []
            piece_t = t[a:z]
            once = np.concatenate(([True], piece_t[1:] != piece_t[:-1]))
            held.append((piece_t[once], v[a:z][once], outside[a:z][once]))
    if key is not None:
        yield close()


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags of rows (recording_id, channel, chunk, at, value, outside, spread), each a chunk."""
    for b in batches:
        for i in range(b.num_rows):
            rec, channel, chunk = (b.column(k)[i].as_py() for k in range(3))
            at, v = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (3, 4))
            outside = b.column(5)[i].values.to_numpy(zero_copy_only=False).astype(bool)
            spread = b.column(6)[i].as_py() or 0.0
            t = at.astype(np.int64) + chunk * CHUNK
            ranges, _, deviation, flagged = analyse(t, v, outside, spread)
            core = (at >= 0) & (at < CHUNK)
            with np.errstate(invalid="ignore"):
                stuck, spike = core & (ranges < STUCK * spread), core & flagged & (deviation > SPIKE * spread)
            rows, reason, score = [], [], []
            for name, where, x in (("stuck", stuck, ranges / (spread or 1.0)), ("spike", spike, deviation / (spread or 1.0)), ("impossible", core & (~np.isfinite(v) | outside), v)):
                rows.append(t[where])
                reason += [name] * int(where.sum())
                score.append(x[where])
            n = len(reason)
            if n:
                arrays = [pa.array([rec] * n, pa.string()), pa.array([channel] * n, pa.int32()), pa.array(np.concatenate(rows)), pa.array(reason, pa.string()), pa.array(np.concatenate(score), pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["recording_id", "channel", "t", "reason", "score"])


def flag_readings(readings: DataFrame, recordings: DataFrame) -> DataFrame:
    """Bad readings: recording_id, channel, t, reason (impossible, stuck or spike) and score.

    ``score`` is the value itself (impossible), the range of the stretch over the spread (stuck) or the
    distance from the level over the spread (spike). A reading may have several reasons, each one row. A
    run of readings far from the level is bad as a whole up to LONGEST samples; a longer one is a new level
    and good as a whole, except where its readings agree with no level either.

    Null values are no readings, and rows with a null recording, channel or t belong to no source: neither
    gives a row. Repeats count once; of different values for one sample the smallest counts. Recordings
    that are not listed, or have null bounds, have no impossible finite values. A source without spread has
    neither spikes nor stuck stretches. Empty tables give an empty result; extra columns are ignored.

    One shuffle of the readings, by chunk of a source: no source, however large, makes a task larger. The
    chunks are written as one row each, and read again once the spreads are known.
    """
    stages = Stages(readings.sparkSession, "spikes")
    margin = LONGEST + SETTLE
    limits = recordings.groupBy(F.col("recording_id").alias("r")).agg(F.min("adc_min").alias("low"), F.max("adc_max").alias("high"))
    chunk = F.floor(F.col("t") / CHUNK)
    place = F.pmod("t", F.lit(CHUNK))
    rows = (
        readings.select("recording_id", F.col("channel").cast("int").alias("channel"), F.col("t").cast("bigint").alias("t"), F.col("value").cast("double").alias("value"))
        .where("value is not null and recording_id is not null and channel is not null and t is not null")
        .join(limits, F.col("recording_id") == F.col("r"), "left")
        .select("recording_id", "channel", "t", "value", F.coalesce((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), F.lit(False)).alias("outside"))
        .withColumn(
            "chunk",
            F.explode(F.when(place < margin, F.array(chunk, chunk - 1)).when(place >= CHUNK - margin, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))),
        )
        .select(F.xxhash64("recording_id", "channel", "chunk").alias("g"), "recording_id", "channel", "chunk", "t", "value", "outside")
        .repartition("g")
        .sortWithinPartitions("g", "recording_id", "channel", "chunk", "t", "value")
    )
    chunks = stages.write(rows.mapInArrow(_gather, _CHUNKS), **{"parquet.block.size": 16 << 20})
    spread = (
        chunks.select("recording_id", "channel", F.inline(F.arrays_zip("bin", "n")))
        .groupBy("recording_id", "channel")
        .agg(F.expr("percentile(bin, 0.5, n)").alias("bin"))
        .select("recording_id", "channel", (F.lit(TO_SIGMA) * F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS)).alias("spread"))
    )
    # written first: Spark then knows its size, and moves the chunks only where it is too large to broadcast
    judged = chunks.join(stages.write(spread), ["recording_id", "channel"], "left").select("recording_id", "channel", "chunk", "at", "value", "outside", "spread")
    return judged.mapInArrow(_flag, _FLAGS)


def found_readings(readings: DataFrame, recordings: DataFrame) -> DataFrame:
    """p3_found: recording_id, channel, t of each bad reading."""
    return flag_readings(readings, recordings).select("recording_id", "channel", "t").distinct()
