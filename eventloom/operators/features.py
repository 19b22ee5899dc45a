"""Features of clips, and clustering by them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.kernels.branch import branch_cluster as branch_kernel
from eventloom.kernels.branch import channel_features as channel_kernel
from eventloom.kernels.branch import consolidated
from eventloom.kernels.features import ITERATIONS, components_of
from eventloom.kernels.isosplit import isosplit
from eventloom.operators.joins import clip_vectors as joined_vectors
from eventloom.operators.series import BY, CHANNEL, extent


def clip_vectors(clips: DataFrame) -> DataFrame:
    """recording_id, event_id, x: each clip flattened, channels running fastest."""
    parts = F.sort_array(F.collect_list(F.struct("dt", "channel", "value")))
    return clips.groupBy(*BY, "event_id").agg(F.transform(parts, lambda s: s["value"]).alias("x"))


def _moments(vectors: DataFrame, subtract_mean: bool) -> DataFrame:
    """recording_id, n, s, m: count, sum and flattened second moments of each recording's vectors, partial
    per batch and then added: what is shuffled is one matrix per recording and batch."""

    def partial(batches):
        for pdf in batches:
            rows = []
            for rec, g in pdf.groupby("recording_id"):
                x = np.array(g["x"].tolist())
                rows.append((rec, len(x), x.sum(axis=0).tolist(), (x.T @ x).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["recording_id", "n", "s", "m"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, m = int(pdf["n"].sum()), np.sum(pdf["s"].tolist(), axis=0), np.sum(pdf["m"].tolist(), axis=0)
        if subtract_mean:
            m = m - np.outer(s, s).ravel() / max(n, 1)
        return pd.DataFrame({"recording_id": [pdf["recording_id"].iloc[0]], "n": [n], "m": [m.tolist()]})

    shape = "recording_id string, n bigint, s array<double>, m array<double>"
    return vectors.select(*BY, "x").mapInPandas(partial, shape).groupBy(*BY).applyInPandas(total, "recording_id string, n bigint, m array<double>")


def components(vectors: DataFrame, k: int, subtract_mean: bool = False, iterations: int = ITERATIONS) -> DataFrame:
    """recording_id, component (from 1), direction: principal directions of each recording's vectors."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["m"].iloc[0])
        d = int(round(len(m) ** 0.5))
        c = components_of(m.reshape(d, d), k, iterations)
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "component": np.arange(1, k + 1), "direction": list(c.T)})

    return _moments(vectors, subtract_mean).groupBy(*BY).applyInPandas(solve, "recording_id string, component int, direction array<double>")


def extract_clips_features(series: DataFrame, firings: DataFrame, clip_size: int, num_features: int, subtract_mean: bool = False) -> DataFrame:
    """recording_id, event_id, features: principal features of the clips themselves, also where the
    directions are those of centred clips."""
    v = joined_vectors(series, firings, clip_size)
    c = components(v, num_features, subtract_mean)
    dot = F.aggregate(F.zip_with("x", "direction", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    each = v.join(c, BY).select(*BY, "event_id", F.struct("component", dot.alias("v")).alias("f"))
    return each.groupBy(*BY, "event_id").agg(F.transform(F.sort_array(F.collect_list("f")), lambda s: s["v"]).alias("features"))


def channel_features(clips: DataFrame, num_features: int, subtract_mean: bool = False) -> DataFrame:
    """recording_id, event_id, features: principal features of each channel's own part of the clips, one channel
    after the other."""
    part = F.to_json(F.struct(*BY, "channel"))
    v = clip_vectors(clips.withColumn("recording_id", part))
    c = components(v, num_features, subtract_mean)
    dot = F.aggregate(F.zip_with("x", "direction", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    each = v.join(c, BY).select(F.get_json_object("recording_id", "$.recording_id").alias("recording_id"), "event_id", F.struct(F.get_json_object("recording_id", "$.channel").cast("int").alias("channel"), "component", dot.alias("v")).alias("f"))
    return each.groupBy(*BY, "event_id").agg(F.transform(F.sort_array(F.collect_list("f")), lambda s: s["v"]).alias("features"))


def spatial_centroid(clips: DataFrame, geom: DataFrame) -> DataFrame:
    """recording_id, event_id, x, y: the centre of the clip's energy over the channels' places (channel, x, y)."""
    energy = clips.groupBy(*BY, "event_id", "channel").agg(F.sum(F.col("value") * F.col("value")).alias("e")).join(geom, "channel")
    at = lambda c: F.coalesce(F.sum(F.col("e") * F.col(c)) / F.nullif(F.sum("e"), F.lit(0.0)), F.lit(0.0)).alias(c)
    return energy.groupBy(*BY, "event_id").agg(at("x"), at("y"))


def isosplit_clusters(features: DataFrame, by: list[str], column: str = "features", threshold: float = 1.5, k_init: int = 30, seed: int = 0) -> DataFrame:
    """The rows with a cluster label (1, 2, ...) within each group of ``by``: a group is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        return pdf.assign(cluster=isosplit(np.array(pdf[column].tolist(), float), threshold, k_init, seed))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields)
    return features.groupBy(*by).applyInPandas(run, f"{fields}, cluster int")


def branch_cluster(series: DataFrame, detections: DataFrame, adjacency: DataFrame, clip_size: int, num_features: int = 10, isocut_threshold: float = 1.5, min_shell_size: int = 150, shell_increment: float = 0.0, consolidation_factor: float = 0.9, detect_interval: int = 10, num_features2: int = 0) -> DataFrame:
    """recording_id, channel, time, label of detections (recording_id, channel, time from 1): clips on each
    channel's neighbourhood (adjacency ch1, ch2; always with the channel itself, which comes first) split into
    clusters per channel, each cluster split once more at the end, clusters dropped that are stronger on another
    channel or off centre, and labels numbered by channel and template peak. ``num_features2``: so many features
    of each channel's part of the clips, computed first, are clustered in place of the clips."""
    size = extent(series)
    d = detections.select(*BY, F.struct("channel", "time").alias("event_id"), (F.col("time") - 1).alias("time"))
    clips = joined_vectors(series, d, clip_size).join(size.select(*BY, "channels"), BY).select(*BY, "event_id.channel", "event_id.time", "channels", "x")
    return cluster_clips(clips, size, adjacency, clip_size, num_features, isocut_threshold, min_shell_size, shell_increment, consolidation_factor, detect_interval, num_features2=num_features2)


def cluster_clips(clips: DataFrame, size: DataFrame, adjacency: DataFrame, clip_size: int, num_features: int = 10, isocut_threshold: float = 1.5, min_shell_size: int = 150, shell_increment: float = 0.0, consolidation_factor: float = 0.9, detect_interval: int = 10, edges: bool = False, num_features2: int = 0) -> DataFrame:
    """``branch_cluster`` of clips (recording_id, channel, time from 1, channels, x flattened with channels running
    fastest) in recordings of the size given (recording_id, n, channels); ``edges``: events that ``detect``
    leaves out at the ends are dropped. A channel is one group, and a row per cluster leaves it."""
    mid = (clip_size + 1) // 2 - 1
    by = [c for c in BY if c in adjacency.columns]
    near = adjacency.groupBy(*by, F.col("ch1").alias("channel")).agg(F.collect_set("ch2").alias("near"))
    places = size.select(*BY, "n", "channels", F.explode("channels").alias("channel")).join(near, [*by, "channel"], "left").select(*(F.col(c).alias(c) for c in (*CHANNEL, "n", "channels", "near")))  # names of its own beside the clips

    def run(pdf: pd.DataFrame, place: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: pd.Series(dtype=object) for c in ("recording_id", "channel", "local", "peak", "times")})
        if not len(pdf) or not len(place):
            return none
        n, channels, own = int(place["n"].iloc[0]), np.array(place["channels"].iloc[0]), int(place["channel"].iloc[0])
        pdf = pdf.sort_values("time")
        t = (pdf["time"].to_numpy() - 1).astype(np.int64)
        if edges:
            inner = (t >= mid) & (t + mid < n)
            pdf, t = pdf[inner], t[inner]
            if not len(pdf):
                return none
        x = np.zeros((len(pdf), clip_size, len(channels)))
        held = pdf["channels"].map(tuple)
        for names in held.unique():
            rows = np.flatnonzero((held == names).to_numpy())
            x[np.ix_(rows, np.arange(clip_size), np.searchsorted(channels, names))] = np.stack(pdf["x"].iloc[rows].to_list()).reshape(len(rows), clip_size, len(names))
        at = int(np.searchsorted(channels, own))
        height = x[:, min(mid + 1, clip_size - 1), at].copy()  # as templates have it: the time from 1 indexes the sample
        x[(t < mid) | (t - mid + clip_size > n)] = 0.0
        beside = place["near"].iloc[0]
        around = [at, *np.flatnonzero(np.isin(channels, () if beside is None else beside) & (channels != own))]
        mine = x[:, :, around]
        vectors = channel_kernel(mine, num_features2) if num_features2 else None
        label = branch_kernel(mine.reshape(len(x), -1), mine[:, mid, 0], num_features, isocut_threshold, shell_increment, min_shell_size, vectors)
        local, _ = consolidated(x, label, at, consolidation_factor, detect_interval)
        time = pdf["time"].to_numpy()
        return pd.DataFrame({"recording_id": place["recording_id"].iloc[0], "channel": own, "local": local, "peak": np.array([height[label == k].mean() for k in local], float), "times": pd.Series([time[label == k] for k in local], dtype=object)})

    parts = int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: the work of a few bytes is long, so partitions must not be merged by size
    spread = lambda df: df.repartition(parts, *CHANNEL).groupBy(*CHANNEL)
    found = spread(clips).cogroup(spread(places)).applyInPandas(run, "recording_id string, channel int, local int, peak double, times array<double>")
    w = Window.partitionBy(*BY).orderBy("channel", "peak", "local")
    return found.withColumn("label", F.row_number().over(w)).select(*BY, "channel", F.explode("times").alias("time"), "label")
