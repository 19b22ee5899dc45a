"""Detection of events in the series, and fitting of templates to it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.kernels.pursuit import detect as greedy
from eventloom.kernels.pursuit import pursue
from eventloom.operators.aggregates import compute_templates
from eventloom.operators.metrics import split_into_shells
from eventloom.operators.series import BY, CHANNEL, halo, packed, unpacked

CHUNK = 1 << 16


def _signal(series: DataFrame, sign: int, individual: bool) -> DataFrame:
    v = F.col("value") if sign > 0 else -F.col("value") if sign < 0 else F.abs("value")
    out = series.withColumn("value", v)
    if not individual:
        out = out.groupBy(*BY, "t").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("value")).withColumn("channel", F.lit(1))
    return out.select(*CHANNEL, "t", "value")


def _edges(events: DataFrame, series: DataFrame, clip_size: int) -> DataFrame:
    mid = (clip_size + 1) // 2 - 1
    size = series.groupBy(*BY).agg((F.max("t") + 1).alias("n"))
    return events.join(size, BY).where((F.col("t") >= mid) & (F.col("t") + mid < F.col("n"))).drop("n")


def detect(series: DataFrame, clip_size: int, interval: int, threshold: float, sign: int = 0, individual_channels: bool = True, chunk: int = CHUNK) -> DataFrame:
    """recording_id, channel, time (from 1): peaks at or above the threshold, one within each interval.

    The signal is x, -x (sign < 0) or |x| (0), or its maximum over channels. The greedy scan runs per chunk
    of a channel with a margin; only samples that reach the threshold are shuffled."""
    signal = _signal(series, sign, individual_channels).where(F.col("value") >= threshold)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t = pdf["t"].to_numpy()
        base = t[0]
        dense = np.full(t[-1] - base + 1, -np.inf)
        dense[t - base] = pdf["value"].to_numpy()
        at = greedy(dense, threshold, interval) + base
        at = at[at // chunk == pdf["chunk"].iloc[0]]
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "channel": pdf["channel"].iloc[0], "t": at})

    found = halo(signal, chunk, min(chunk, 100 * interval)).groupBy(*CHANNEL, "chunk").applyInPandas(run, "recording_id string, channel int, t bigint")
    return _edges(found, series, clip_size).select(*CHANNEL, (F.col("t") + 1).cast("double").alias("time"))


def detected_clips(series: DataFrame, clip_size: int, interval: int, threshold: float, sign: int = 0, chunk: int = CHUNK) -> DataFrame:
    """recording_id, channel, time (from 1), channels, x: the events of ``detect`` on each channel with their clips
    (flattened, channels running fastest, missing samples zero) in one pass over the series, which may
    hold repeats. Events whose window crosses an end of the recording are still among them."""
    mid = (clip_size + 1) // 2 - 1
    margin = min(chunk, max(100 * interval, clip_size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["chunk"].iloc[0]) * chunk
        names, start, dense, present = unpacked(pdf)
        signal = np.where(present, dense if sign > 0 else -dense if sign < 0 else np.abs(dense), -np.inf)
        around = np.concatenate((np.zeros((clip_size, len(names))), dense, np.zeros((clip_size, len(names)))))
        out = []
        for name, y in zip(names.tolist(), signal.T):
            at = greedy(np.ascontiguousarray(y), threshold, interval)
            at = at[(at + start >= 0) & (at + start < chunk)]
            x = around[(at - mid + clip_size)[:, None] + np.arange(clip_size)].reshape(len(at), clip_size * len(names))
            out.append(pd.DataFrame({"channel": name, "time": at + (base + start + 1.0), "x": pd.Series(list(x), dtype=object)}))
        out = pd.concat(out, ignore_index=True)
        return out.assign(recording_id=pdf["recording_id"].iloc[0], channels=pd.Series([names] * len(out), out.index, dtype=object))

    shape = "recording_id string, channel int, time double, channels array<int>, x array<double>"
    return packed(series, chunk, margin).groupBy(*BY, "chunk").applyInPandas(run, shape)


def detect_local_max(series: DataFrame, clip_size: int, interval: int, threshold: float, sign: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The same for samples that are the first maximum within +-interval, in built-in windows alone; it
    differs from ``detect`` where peaks keep growing within the interval of each other."""
    rows = halo(_signal(series, sign, True).where(F.col("value") >= threshold), chunk, interval)
    w = Window.partitionBy(*CHANNEL, "chunk").orderBy("t")
    before, after = F.max("value").over(w.rangeBetween(-interval, -1)), F.max("value").over(w.rangeBetween(1, interval))
    top = rows.withColumns({"before": before, "after": after}).where(F.expr(f"t div {chunk}") == F.col("chunk"))
    top = top.where((F.col("before").isNull() | (F.col("value") > F.col("before"))) & (F.col("after").isNull() | (F.col("value") >= F.col("after"))))
    return _edges(top, series, clip_size).select(*CHANNEL, (F.col("t") + 1).cast("double").alias("time"))


def fit_stage(series: DataFrame, firings: DataFrame, clip_size: int, least: float = 30.0, chunk: int = CHUNK, margin: int = 2048, shell_increment: float = 0.0, min_shell_size: int = 150) -> DataFrame:
    """The firings that matching pursuit keeps: those whose template explains energy of at least ``least``
    that no other event has explained yet. Chunks have a margin, in which neighbours decide on their own.

    With ``shell_increment``, each label's shells of amplitude have templates of their own; labels stay."""
    split = split_into_shells(firings, shell_increment, min_shell_size) if shell_increment else firings
    templates = compute_templates(series, split, clip_size)
    events = split.where("label > 0").select("event_id", *BY, "label", F.col("time").cast("bigint").alias("t"))
    e = halo(events, chunk, margin)
    s = halo(series, chunk, margin)
    shapes = templates.select(*BY, "label", "channel", "dt", "mean")
    chunks = s.select(*BY, "chunk").distinct()
    packed = (
        s.select(*BY, "chunk", F.lit(0).alias("kind"), "channel", "t", "value", F.lit(0).cast("bigint").alias("event_id"), F.lit(0).alias("label"))
        .unionByName(e.select(*BY, "chunk", F.lit(1).alias("kind"), F.lit(0).alias("channel"), "t", F.lit(0.0).alias("value"), "event_id", "label"))
        .unionByName(shapes.join(chunks, BY).select(*BY, "chunk", F.lit(2).alias("kind"), "channel", F.col("dt").cast("bigint").alias("t"), F.col("mean").alias("value"), F.lit(0).cast("bigint").alias("event_id"), "label"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].to_numpy()
        x, ev, te = pdf[kind == 0], pdf[kind == 1].sort_values(["t", "event_id"]), pdf[kind == 2]
        if not len(ev) or not len(x):
            return pd.DataFrame({"event_id": np.zeros(0, np.int64)})
        base, m = int(x["t"].min()), int(max(x["channel"].max(), te["channel"].max()))
        dense = np.zeros((m, int(x["t"].max()) - base + 1))
        dense[x["channel"].to_numpy() - 1, x["t"].to_numpy() - base] = x["value"].to_numpy()
        known = {}
        for k, g in te.groupby("label"):
            known[int(k)] = np.zeros((m, clip_size))
            known[int(k)][g["channel"].to_numpy() - 1, g["t"].to_numpy()] = g["value"].to_numpy()
        t = ev["t"].to_numpy()
        kept = pursue(dense, t - base, ev["label"].to_numpy(), known, clip_size, least)
        return pd.DataFrame({"event_id": ev["event_id"].to_numpy()[kept & (t // chunk == pdf["chunk"].iloc[0])]})

    kept = packed.groupBy(*BY, "chunk").applyInPandas(run, "event_id bigint")
    return firings.join(kept, "event_id", "left_semi")
