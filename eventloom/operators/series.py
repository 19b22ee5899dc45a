"""Transforms of the series: one row per sample (recording_id, channel, t, value), t from 0.

``BY`` names what separates one array from another; every operator works per recording, so a table of
many recordings runs as one plan. Statistics per channel are aggregations joined back, not windows: they
combine before the shuffle, and a channel of any length stays spread over the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.runtime import Stages

BY = ["recording_id"]
CHANNEL = [*BY, "channel"]
SAMPLE = "recording_id string, channel int, t bigint, value double"


def readings(timeseries: DataFrame) -> DataFrame:
    """The series behind a dirty table: finite readings, repeats once."""
    return finite(timeseries).distinct()


def finite(timeseries: DataFrame) -> DataFrame:
    """The finite readings of a dirty table, repeats included."""
    v = F.col("value")
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return timeseries.select(*CHANNEL, "t", "value").where(fine)


def extent(series: DataFrame) -> DataFrame:
    """recording_id, n, channels: length and channels of each recording."""
    each = series.groupBy(*CHANNEL).agg(F.max("t").alias("t"))
    return each.groupBy(*BY).agg((F.max("t") + 1).alias("n"), F.sort_array(F.collect_set("channel")).alias("channels"))


def extract_raw(series: DataFrame, t1: int = -1, t2: int = -1, channels: Sequence[int] = ()) -> DataFrame:
    """Samples t1..t2 (from 1, both ends included; t1 < 0: all), channels in the given order, renumbered
    from 1; a channel may be listed more than once."""
    out = series
    if t1 >= 0:
        if t1 < 1 or t2 < t1:
            raise ValueError(f"no such range of samples: {t1}..{t2}")
        out = out.where(F.col("t").between(t1 - 1, t2 - 1)).withColumn("t", F.col("t") - (t1 - 1))
    if channels:
        places = {c: [i for i, x in enumerate(channels, 1) if x == c] for c in sorted(set(channels))}
        place = F.create_map(*(x for c, p in places.items() for x in (F.lit(c), F.array(*map(F.lit, p)))))
        out = out.where(F.col("channel").isin(*places)).select(*BY, F.explode(place[F.col("channel")]).alias("channel"), "t", "value")
    return out.select(*CHANNEL, "t", "value")


def read_chunk(series: DataFrame, start: int, size: int) -> DataFrame:
    """``size`` samples from ``start`` of every channel; zero where the array has none. The range reaches
    the scan as a filter."""
    grid = series.select(*CHANNEL).distinct().select(*CHANNEL, F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(start + size - 1).cast("bigint"))).alias("t"))
    part = series.where(F.col("t").between(start, start + size - 1))
    return grid.join(part, [*CHANNEL, "t"], "left").select(*CHANNEL, "t", F.coalesce("value", F.lit(0.0)).alias("value"))


def write_chunk(series: DataFrame, chunk: DataFrame, start: int) -> DataFrame:
    """The series with the samples of ``chunk`` (t from 0) put at ``start``, in place of those that are there."""
    put = chunk.select(*CHANNEL, (F.col("t") + start).alias("t"), "value")
    return series.join(put, [*CHANNEL, "t"], "left_anti").select(*CHANNEL, "t", "value").unionByName(put)


def transpose(series: DataFrame) -> DataFrame:
    """Channels and samples swapped."""
    return series.select(*BY, (F.col("t") + 1).cast("int").alias("channel"), (F.col("channel") - 1).cast("bigint").alias("t"), "value")


def reshape(series: DataFrame, n_channels: int, new_channels: int) -> DataFrame:
    """The same values with another number of channels; the first dimension runs fastest."""
    at = F.col("channel") - 1 + F.col("t") * n_channels
    return series.select(*BY, (at % new_channels + 1).cast("int").alias("channel"), F.expr(f"(channel - 1 + t * {n_channels}) div {new_channels}").alias("t"), "value")


def value_range(series: DataFrame) -> DataFrame:
    return series.groupBy(*BY).agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))


def _scaled(series: DataFrame, divisor: Column) -> DataFrame:
    per = series.groupBy(*CHANNEL).agg(divisor.alias("d"))
    safe = F.when(F.coalesce(F.col("d"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("d"))
    return series.join(per, CHANNEL).select(*CHANNEL, "t", (F.col("value") / safe).alias("value"))


def _root_mean_square() -> Column:
    n = F.count("*")
    return F.when(n > 1, F.sqrt(F.sum(F.col("value") * F.col("value")) / (n - 1)))


def normalize_channels(series: DataFrame) -> DataFrame:
    """Each channel over sqrt(sum x^2 / (n - 1)), without subtracting a mean; a zero channel stays."""
    return _scaled(series, _root_mean_square())


def normalize_channels_std(series: DataFrame) -> DataFrame:
    return _scaled(series, F.stddev_pop("value"))


def normalize_channels_clamped(series: DataFrame, limit: float = 20.0) -> DataFrame:
    """Over the standard deviation, clamped to +-limit, and over that one's standard deviation again."""
    once = _scaled(series, F.stddev_samp("value"))
    return _scaled(once.withColumn("value", F.greatest(F.least("value", F.lit(limit)), F.lit(-limit))), F.stddev_samp("value"))


def _frames(series: DataFrame) -> DataFrame:
    """recording_id, t, channels, x: the samples of one time in one row, channels in order."""
    held = F.sort_array(F.collect_list(F.struct("channel", "value")))
    return series.groupBy(*BY, "t").agg(held.alias("f")).select(*BY, "t", F.transform("f", lambda s: s["channel"]).alias("channels"), F.transform("f", lambda s: s["value"]).alias("x"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(recording, rows, channels, values, held) of the frames of a batch: dense arrays, zero where a frame lacks
    a channel."""
    rec, channels = batch.column(0).to_pandas(), batch.column(2).flatten().to_numpy(zero_copy_only=False)
    values = batch.column(3).flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
    code, names = pd.factorize(rec)
    for i, name in enumerate(names):
        rows = np.flatnonzero(code == i)
        of = np.full(batch.num_rows, -1)
        of[rows] = np.arange(len(rows))
        mine = of[row] >= 0
        known, at = np.unique(channels[mine], return_inverse=True)
        x, held = np.zeros((len(rows), len(known))), np.zeros((len(rows), len(known)), bool)
        x[of[row[mine]], at] = values[mine]
        held[of[row[mine]], at] = True
        yield name, rows, known, x, held


def covariance(series: DataFrame) -> DataFrame:
    """channel1, channel2, value: sum over t of x1 x2 / (n - 1), uncentred, over samples both channels hold.

    Samples of one time meet in one row; each batch of such rows gives one matrix product, and what is
    shuffled after that is a matrix of channels by channels per batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, _, known, x, held in _blocks(batch):
                m, n = x.T @ x, held.T.astype(float) @ held
                i, j = np.nonzero(n)
                arrays = [pa.array([name] * len(i), pa.string()), pa.array(known[i], pa.int32()), pa.array(known[j], pa.int32()), pa.array(m[i, j]), pa.array(n[i, j])]
                yield pa.RecordBatch.from_arrays(arrays, names=["recording_id", "channel1", "channel2", "s", "n"])

    part = _frames(series).mapInArrow(partial, "recording_id string, channel1 int, channel2 int, s double, n double")
    return part.groupBy(*BY, "channel1", "channel2").agg((F.sum("s") / F.greatest(F.sum("n") - 1, F.lit(1.0))).alias("value"))


def whitening(cov: DataFrame) -> DataFrame:
    """channel_out, channel_in, weight: U diag(lambda^-1/2) U' of each recording's covariance.

    A group is one matrix of channels by channels. Directions without variance get no weight."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="channel1", columns="channel2", values="value", fill_value=0.0)
        lam, u = np.linalg.eigh((m.to_numpy() + m.to_numpy().T) / 2)
        root = np.where(lam > 1e-12 * max(lam.max(), 1e-300), 1 / np.sqrt(np.maximum(lam, 1e-300)), 0.0)
        w = (u * root) @ u.T
        i, j = np.meshgrid(m.index, m.columns, indexing="ij")
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "channel_out": i.ravel(), "channel_in": j.ravel(), "weight": w.ravel()})

    return cov.groupBy(*BY).applyInPandas(solve, "recording_id string, channel_out int, channel_in int, weight double")


def whiten(series: DataFrame) -> DataFrame:
    """Every sample as the weighted sum over channels that makes the channels uncorrelated with unit power.

    A frame is one row, joined with its recording's matrix (channels by channels) and multiplied with it."""
    rows = F.sort_array(F.collect_list(F.struct("channel_out", "channel_in", "weight")))
    matrix = whitening(covariance(series)).groupBy(*BY).agg(F.array_sort(F.collect_set("channel_out")).alias("outs"), F.transform(rows, lambda s: s["weight"]).alias("w"))
    matrix = Stages(series.sparkSession, "whiten").write(matrix)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(1).to_numpy()
            for name, rows, known, x, _ in _blocks(batch):
                outs = batch.column(4)[int(rows[0])].values.to_numpy()
                w = batch.column(5)[int(rows[0])].values.to_numpy().reshape(len(outs), len(outs))
                y = x @ w[:, np.searchsorted(outs, known)].T
                arrays = [pa.array([name] * y.size, pa.string()), pa.array(np.tile(outs, len(rows)), pa.int32()), pa.array(np.repeat(t[rows], len(outs))), pa.array(y.ravel())]
                yield pa.RecordBatch.from_arrays(arrays, names=["recording_id", "channel", "t", "value"])

    return _frames(series).join(matrix, BY).select(*BY, "t", "channels", "x", "outs", "w").mapInArrow(apply, SAMPLE)


def mask_out_artifacts(series: DataFrame, threshold: float, interval_size: int, compat: bool = False) -> DataFrame:
    """Intervals whose norm exceeds mean + threshold * deviation of their channel's norms become zero, as do
    their neighbours and the incomplete last interval. Equal norms, whose mean may differ from them by
    rounding, do not exceed it. ``compat``: an interval is zero only where all
    channels are bad."""
    cut = series.withColumn("interval", F.expr(f"t div {interval_size}"))
    end = series.groupBy(*BY).agg((F.max("t") + 1).alias("n")).select(*BY, F.expr(f"n div {interval_size}").alias("whole"))
    norm = cut.groupBy(*CHANNEL, "interval").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).join(end, BY).where("interval < whole")
    stats = norm.groupBy(*CHANNEL).agg(F.avg("norm").alias("mean"), F.coalesce(F.stddev_samp("norm"), F.lit(0.0)).alias("sd"))
    w = Window.partitionBy(*CHANNEL).orderBy("interval")
    high = norm.join(stats, CHANNEL).select(*CHANNEL, "interval", (F.col("norm") > F.col("mean") * (1 + 1e-9) + threshold * F.col("sd")).alias("high"))
    near = lambda c: F.coalesce(F.when(F.abs(c("interval", 1).over(w) - F.col("interval")) == 1, c("high", 1).over(w)), F.lit(False))
    bad = high.select(*CHANNEL, "interval", (F.col("high") | near(F.lag) | near(F.lead)).alias("bad"))
    if compat:
        bad = bad.join(bad.groupBy(*BY, "interval").agg(F.min("bad").alias("all")), [*BY, "interval"]).select(*CHANNEL, "interval", F.col("all").alias("bad"))
    return cut.join(bad, [*CHANNEL, "interval"], "left").select(*CHANNEL, "t", F.when(F.coalesce("bad", F.lit(True)), 0.0).otherwise(F.col("value")).alias("value"))


DYNAMIC_RANGE = {"uint8": 255, "uint16": 65535, "uint32": 4294967295, "int16": 32767, "int32": 2147483647}  # fixed values


def quantize(series: DataFrame, output_format: str) -> DataFrame:
    """Values scaled so that the largest magnitude of a recording fills the format, cut to whole numbers;
    unsigned formats have zero for negative values."""
    top = DYNAMIC_RANGE[output_format]
    per = series.groupBy(*BY).agg(F.max(F.abs("value")).alias("maxabs"))
    x = F.col("value") * (F.lit(float(top)) / F.when(F.col("maxabs") == 0, 1.0).otherwise(F.col("maxabs")))
    x = F.greatest(x, F.lit(0.0)) if output_format.startswith("u") else x
    return series.join(per, BY).select(*CHANNEL, "t", x.cast("bigint").alias("value"))


def quantize8(series: DataFrame) -> DataFrame:
    """code (0..255), vmin, vmax of each recording's linear 8-bit coding."""
    span = F.col("vmax") - F.col("vmin")
    code = F.when(span == 0, 0.0).otherwise((F.col("value") - F.col("vmin")) / F.when(span == 0, 1.0).otherwise(span) * 255)
    return series.join(value_range(series), BY).select(*CHANNEL, "t", F.floor(code).cast("int").alias("code"), "vmin", "vmax")


def unquantize8(coded: DataFrame) -> DataFrame:
    return coded.select(*CHANNEL, "t", (F.col("vmin") + F.col("code") / F.lit(255.0) * (F.col("vmax") - F.col("vmin"))).alias("value"))


def quantile_codec(series: DataFrame) -> DataFrame:
    """code, level: 8-bit coding by quantiles; level is the mean of the values that share a code.

    Codes come from 255 approximate quantiles of a recording (error 1e-4 of the ranks), not from a sort."""
    cuts = series.groupBy(*BY).agg(F.percentile_approx("value", [i / 256 for i in range(1, 256)], 10_000).alias("cuts"))
    coded = series.join(cuts, BY).withColumn("code", F.expr("size(filter(cuts, c -> c < value))")).drop("cuts")
    table = coded.groupBy(*BY, "code").agg(F.avg("value").alias("level"))
    return coded.join(table, [*BY, "code"]).select(*CHANNEL, "t", "code", "level")


def add_noise(series: DataFrame, noise_level: float, seed: int = 0) -> DataFrame:
    """Gaussian noise that depends on the sample's place and the seed only, so a retried task repeats it."""
    u = lambda k: (F.pmod(F.xxhash64(*CHANNEL, "t", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    return series.select(*CHANNEL, "t", (F.col("value") + noise_level * normal).alias("value"))


def multiscale(series: DataFrame) -> DataFrame:
    """ds_factor, channel, bin, vmin, vmax: minima and maxima over blocks of 3, 9, 27, ... samples, up to one
    block for all. Samples that the array lacks count as zero, those up to the next power of 3 too.

    Each level is made from the one below, so the samples are read once."""
    size = series.groupBy(*BY).agg((F.max("t") + 1).alias("n")).select(*BY, "n", F.greatest(F.lit(1), F.ceil(F.log(F.col("n").cast("double")) / math.log(3) - 1e-9)).cast("int").alias("levels"))
    top = size.agg(F.max("levels")).first()[0] or 0
    level = series.groupBy(*CHANNEL, F.expr("t div 3").alias("bin")).agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.count("*").alias("held"))
    out = None
    for r in range(1, top + 1):
        if r > 1:
            level = level.groupBy(*CHANNEL, F.expr("bin div 3").alias("bin")).agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.sum("held").alias("held"))
        short = F.col("held") < 3**r
        part = level.join(size.where(F.col("levels") >= r), BY).select(
            F.lit(3**r).cast("bigint").alias("ds_factor"), *CHANNEL, "bin",
            F.when(short, F.least("vmin", F.lit(0.0))).otherwise(F.col("vmin")).alias("vmin"), F.when(short, F.greatest("vmax", F.lit(0.0))).otherwise(F.col("vmax")).alias("vmax"),
        )
        out = part if out is None else out.unionByName(part)
    return out if out is not None else level.select(F.lit(3).cast("bigint").alias("ds_factor"), *CHANNEL, "bin", "vmin", "vmax")


def read_multiscale(levels: DataFrame, series: DataFrame, t1: int, t2: int, ds_factor: int) -> DataFrame:
    """recording_id, channel, bin (t1..t2), vmin, vmax of one level of ``multiscale``; factor 1 reads the series
    itself. Zero where the bin lies outside 0..n / factor - 1 or holds no sample."""
    if t2 < t1:
        raise ValueError(f"no such range of bins: {t1}..{t2}")
    power = 1
    while power < ds_factor:
        power *= 3
    if power != ds_factor:
        raise ValueError(f"no power of 3: {ds_factor}")
    if ds_factor == 1:
        held = series.select(*CHANNEL, F.col("t").alias("bin"), F.col("value").alias("vmin"), F.col("value").alias("vmax"))
    else:
        held = levels.where(F.col("ds_factor") == ds_factor).select(*CHANNEL, "bin", "vmin", "vmax")
    held = held.where(F.col("bin").between(t1, t2))
    last = series.groupBy(*BY).agg(F.expr(f"(max(t) + 1) div {ds_factor} - 1").alias("last"))
    grid = series.select(*CHANNEL).distinct().join(last, BY).select(*CHANNEL, "last", F.explode(F.sequence(F.lit(t1).cast("bigint"), F.lit(t2).cast("bigint"))).alias("bin"))
    inside = (F.col("bin") >= 0) & (F.col("bin") <= F.col("last"))
    zero = lambda c: F.when(inside, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c)
    return grid.join(held, [*CHANNEL, "bin"], "left").select(*CHANNEL, "bin", zero("vmin"), zero("vmax"))


def significant(v: Column, digits: int = 2) -> Column:
    """The value at so many significant figures, as axes are labelled; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.nullif(v, F.lit(0.0))))) - (digits - 1))
    return F.coalesce(F.round(v / scale) * scale, v)


def axis_transform(v: Column, kind: str, c: float = 1.0, inverse: bool = False) -> Column:
    """The histogram axes: uniform, log ((1 + ln(v / c)) c above c) and cubic (the cube root of v / c), odd."""
    a = F.abs(v)
    if kind == "uniform":
        return v
    if kind == "log":
        f = F.exp(a / c - 1) * c if inverse else (1 + F.ln(F.greatest(a, F.lit(c)) / c)) * c
        return F.signum(v) * F.when(a > c, f).otherwise(a)
    if kind == "cubic":
        return F.signum(v) * (F.pow(a, F.lit(3.0)) * c if inverse else F.cbrt(a / c))
    raise ValueError(f"no such axis: {kind}")


# --- filters over chunks ---------------------------------------------------------------------------------


def halo(series: DataFrame, chunk: int, margin: int) -> DataFrame:
    """Adds chunk, with every sample also in the neighbouring chunk whose margin it lies in."""
    c, place = F.expr(f"t div {chunk}"), F.col("t") % chunk
    near = F.filter(F.array(c, F.when(place < margin, c - 1), F.when(place >= chunk - margin, c + 1)), lambda x: x.isNotNull() & (x >= 0))
    return series.withColumn("chunk", F.explode(near))


def packed(series: DataFrame, chunk: int, margin: int) -> DataFrame:
    """recording_id, chunk, channel, step, value: the samples of each chunk and its margins (as ``halo``) as
    bytes (int, int, double), a row per batch, in order of channel and time; step is the distance to
    the sample before, at first to the chunk's start, and so packs well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            code, channel, t, value = (c.to_numpy(zero_copy_only=False) for c in (names.indices, *batch.columns[1:]))
            c, place = t // chunk, t % chunk
            before, after = np.flatnonzero((place < margin) & (c > 0)), np.flatnonzero(place >= chunk - margin)
            i = np.concatenate((np.arange(len(t)), before, after))
            c = np.concatenate((c, c[before] - 1, c[after] + 1))
            order = np.lexsort((t[i], channel[i], c, code[i]))
            i, c = i[order], c[order]
            first = np.flatnonzero(np.append(True, (np.diff(code[i]) != 0) | (np.diff(c) != 0)))
            place = t[i] - c * chunk
            step = np.diff(place, prepend=0)
            step[first] = place[first]
            ends = np.append(first, len(i))
            blobs = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (channel[i].astype(np.int32), step.astype(np.int32), value[i])]
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code[i[first]])), pa.array(c[first]), *blobs], ["recording_id", "chunk", "channel", "step", "value"])

    known = series.select(*CHANNEL, "t", "value").where("recording_id IS NOT NULL AND channel IS NOT NULL AND t >= 0")
    return known.mapInArrow(run, "recording_id string, chunk bigint, channel binary, step binary, value binary")


def unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(channels, the first sample's place in the chunk, samples x channels, which are present) of a chunk's rows."""
    channel, step, value = (np.frombuffer(b"".join(pdf[c]), d) for c, d in (("channel", np.int32), ("step", np.int32), ("value", float)))
    size = pdf["channel"].str.len().to_numpy() // 4
    first = np.cumsum(size) - size
    place = np.cumsum(step, dtype=np.int64)
    place -= np.repeat(place[first] - step[first], size)
    names, column = np.unique(channel, return_inverse=True)
    start = int(place.min())
    dense = np.zeros((int(place.max()) - start + 1, len(names)))
    present = np.zeros(dense.shape, bool)
    dense[place - start, column] = value
    present[place - start, column] = True
    return names, start, dense, present


def _per_chunk(series: DataFrame, chunk: int, margin: int, kernel) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t = pdf["t"].to_numpy()
        dense = np.zeros(t[-1] - t[0] + 1)
        dense[t - t[0]] = pdf["value"].to_numpy()
        core = t // chunk == pdf["chunk"].iloc[0]
        return pdf.assign(value=kernel(dense)[t - t[0]]).loc[core, [*CHANNEL, "t", "value"]]

    return halo(series, chunk, margin).groupBy(*CHANNEL, "chunk").applyInPandas(run, SAMPLE)


@lru_cache(maxsize=64)
def band(n: int, samplerate: float, low: float, high: float, width: float) -> np.ndarray:
    """The filter's gain at the frequencies of a transform of n samples; 0 switches a bound off."""
    f = np.abs(np.fft.fftfreq(n, 1 / samplerate))
    erf = np.vectorize(math.erf)
    power = np.ones(n)
    if low:
        power *= (1 + erf(3 * (f - low) / low)) / 2
        power[f == 0] = 0
    if high:
        power *= (1 - erf((f - high) / width)) / 2
    return np.sqrt(power)


def bandpass_filter(series: DataFrame, samplerate: float, freq_min: float, freq_max: float, freq_wid: float = 1000.0, chunk: int = 1 << 16) -> DataFrame:
    """Smooth band pass by Fourier transforms of chunks with a margin of a fifth of a chunk; samples that
    the array lacks count as zero."""

    def kernel(x: np.ndarray) -> np.ndarray:
        return np.fft.ifft(np.fft.fft(x) * band(len(x), samplerate, freq_min, freq_max, freq_wid)).real

    return _per_chunk(series, chunk, chunk // 5, kernel)


def exponential_filter(series: DataFrame, tau: float, high_pass: bool = False, chunk: int = 1 << 16) -> DataFrame:
    """One-pole filter with factor exp(-1/tau), each chunk warmed up on a margin of 40 tau."""
    a = math.exp(-1 / tau)

    def kernel(x: np.ndarray) -> np.ndarray:
        out, y = np.empty_like(x), 0.0
        for i, v in enumerate(x.tolist()):
            y = a * y + (1 - a) * v
            out[i] = y
        return x - out if high_pass else out

    return _per_chunk(series, chunk, min(chunk, math.ceil(40 * tau)), kernel)
