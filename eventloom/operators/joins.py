"""Joins of events with the series, with each other, and of channels with channels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.kernels.assign import hungarian
from eventloom.kernels.match import greedy_pairs, heaviest_pairs
from eventloom.operators.events import carried
from eventloom.operators.series import BY


def range_pairs(a: DataFrame, b: DataFrame, keys: list[str], time_a: str, time_b: str, reach: float) -> DataFrame:
    """All pairs of equal keys at most ``reach`` apart: an equi-join on buckets of that width, with the
    right side in its own and both neighbouring buckets, instead of a nested loop."""
    width = reach if reach > 0 else 1.0
    left = a.withColumn("_bucket", F.floor(F.col(time_a) / width))
    own = F.floor(F.col(time_b) / width)
    right = b.withColumn("_bucket", F.explode(F.array(own - 1, own, own + 1)))
    return left.join(right, [*keys, "_bucket"]).where(F.abs(F.col(time_a) - F.col(time_b)) <= reach).drop("_bucket")


def _length(series: DataFrame) -> DataFrame:
    return series.groupBy(*BY).agg((F.max("t") + 1).alias("n"), F.sort_array(F.collect_set("channel")).alias("channels"))


def _windows(firings: DataFrame, clip_size: int, rounded: bool = False) -> DataFrame:
    """One row per event and offset: t is the sample, t0 the event's own."""
    mid = (clip_size + 1) // 2 - 1
    t0 = F.floor(F.col("time") + 0.5) if rounded else F.col("time").cast("bigint")
    return firings.withColumn("t0", t0).withColumn("dt", F.explode(F.sequence(F.lit(0), F.lit(clip_size - 1)))).withColumn("t", F.col("t0") - mid + F.col("dt"))


def extract_clips(series: DataFrame, firings: DataFrame, clip_size: int, channels: Sequence[int] = ()) -> DataFrame:
    """event_id, channel, dt, value: the series around each event's sample, all zero where the window
    crosses an end of the recording, and zero for samples that are missing.

    Samples of one time are one row (frame) in the join, which is an equi-join on the exploded window."""
    mid = (clip_size + 1) // 2 - 1
    size = _length(series)
    if channels:
        size = size.withColumn("channels", F.array(*map(F.lit, channels)))
        series = series.where(F.col("channel").isin(*channels))
    frames = series.groupBy(*BY, "t").agg(F.map_from_entries(F.collect_list(F.struct("channel", "value"))).alias("x"))
    places = _windows(firings.select("event_id", *BY, "time"), clip_size).join(size, BY)
    inside = (F.col("t0") >= mid) & (F.col("t0") - mid + clip_size <= F.col("n"))
    rows = places.join(frames, [*BY, "t"], "left").select(*BY, "event_id", "dt", inside.alias("inside"), "x", F.explode("channels").alias("channel"))
    return rows.select(*BY, "event_id", "channel", "dt", F.when(F.col("inside"), F.coalesce(F.col("x")[F.col("channel")], F.lit(0.0))).otherwise(0.0).alias("value"))


def clip_vectors(series: DataFrame, firings: DataFrame, clip_size: int) -> DataFrame:
    """recording_id, event_id, x: the clips of ``extract_clips`` flattened, channels running fastest.

    Samples are laid out in chunks that overlap by a window, so that an event meets one row, the chunk its window
    starts in, and is one row itself throughout."""
    mid = (clip_size + 1) // 2 - 1
    chunk = max(128, 2 * clip_size)
    length = chunk + clip_size - 1
    size = _length(series)
    at = F.floor(F.col("t") / chunk)
    both = F.array_compact(F.array(at, F.when(F.col("t") % chunk < clip_size - 1, at - 1)))
    held = series.select(*BY, "channel", "t", "value", F.explode(both).alias("chunk")).select(*BY, "channel", "chunk", (F.col("t") - F.col("chunk") * chunk).cast("int").alias("place"), "value")
    rows = held.groupBy(*BY, "chunk", "channel").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("h"))
    by_place = F.map_from_entries("h")
    gaps = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(by_place[i], F.lit(0.0)))
    dense = F.when(F.size("h") == length, F.transform("h", lambda s: s["value"])).otherwise(gaps)
    chunks = rows.select(*BY, "chunk", "channel", dense.alias("x")).groupBy(*BY, "chunk").agg(F.map_from_entries(F.collect_list(F.struct("channel", "x"))).alias("held"))
    none = F.array_repeat(F.lit(0.0), length)
    chunks = chunks.join(size.select(*BY, "channels"), BY).select(*BY, "chunk", F.transform("channels", lambda c: F.coalesce(F.col("held")[c], none)).alias("rows"))
    start = F.col("time").cast("bigint") - mid
    events = firings.select("event_id", *BY, start.alias("start"), F.floor(start / chunk).alias("chunk"))
    joined = events.join(chunks, [*BY, "chunk"], "left").join(size.select(*BY, "n", F.size("channels").alias("m")), BY)
    first = (F.col("start") - F.col("chunk") * chunk).cast("int")
    clip = F.flatten(F.transform(F.sequence(first, first + (clip_size - 1)), lambda i: F.transform("rows", lambda r: r[i])))
    inside = (F.col("start") >= 0) & (F.col("start") + clip_size <= F.col("n")) & F.col("rows").isNotNull()
    return joined.select(*BY, "event_id", F.when(inside, clip).otherwise(F.array_repeat(F.lit(0.0), (F.col("m") * clip_size).cast("int"))).alias("x"))


def extract_channel_values(series: DataFrame, firings: DataFrame) -> DataFrame:
    """event_id, value of the event's own channel at its sample; zero where there is none."""
    at = firings.select("event_id", *BY, "channel", F.col("time").cast("bigint").alias("t"))
    return at.join(series, [*BY, "channel", "t"], "left").select("event_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def geom2adj(geom: DataFrame, radius: float, channels: Sequence[int] = ()) -> DataFrame:
    """ch1, ch2 of channels (channel, x, y) within the radius, itself included; with ``channels``, numbers
    are positions in that list. An equi-join on square cells of the radius: the neighbourhood has nine."""
    if channels:
        place = F.array_position(F.array(*map(F.lit, channels)), F.col("channel")).cast("int")
        geom = geom.where(F.col("channel").isin(*channels)).withColumn("channel", place)
    side = radius if radius > 0 else 1.0
    cell = lambda c: F.floor(F.col(c) / side)
    a = geom.select(F.col("channel").alias("ch1"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = geom.select(F.col("channel").alias("ch2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.inline(near))
    distance = (F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2
    return a.join(b, ["cx", "cy"]).where(distance <= radius * radius).select("ch1", "ch2")


def linear_adjacency(series: DataFrame, radius: int) -> DataFrame:
    """recording_id, ch1, ch2 of channels whose numbers differ by at most the radius."""
    c = series.select(*BY, "channel").distinct()
    return c.select(*BY, F.col("channel").alias("ch1"), F.explode(F.sequence(F.col("channel") - radius, F.col("channel") + radius)).alias("channel")).join(c, [*BY, "channel"]).select(*BY, "ch1", F.col("channel").alias("ch2"))


def _times(firings: DataFrame, suffix: str) -> DataFrame:
    """Events counted by whole sample, label and recording; many events of one sample are one row."""
    return firings.groupBy(*BY, F.col("label").alias(f"label{suffix}"), F.col("time").cast("bigint").alias(f"t{suffix}")).agg(F.count("*").alias(f"c{suffix}"))


def cross_correlogram(firings: DataFrame, max_dt: int, pairs: DataFrame | None = None) -> DataFrame:
    """label1, label2, dt (= t1 - t2, whole samples), n over all pairs of events of positive labels at most
    max_dt apart, an event with itself excluded. ``pairs`` (label1, label2) restricts the label pairs."""
    f = firings.where("label > 0")
    joined = range_pairs(_times(f, "1"), _times(f, "2"), BY, "t1", "t2", max_dt)
    if pairs is not None:
        joined = joined.join(pairs, ["label1", "label2"], "left_semi")
    self_pair = (F.col("label1") == F.col("label2")) & (F.col("t1") == F.col("t2"))
    n = F.col("c1") * F.when(self_pair, F.col("c2") - 1).otherwise(F.col("c2"))
    return joined.groupBy(*BY, "label1", "label2", (F.col("t1") - F.col("t2")).alias("dt")).agg(F.sum(n).alias("n")).where("n > 0")


def auto_correlogram(firings: DataFrame, max_dt: int) -> DataFrame:
    labels = firings.select(F.col("label").alias("label1"), F.col("label").alias("label2")).distinct()
    return cross_correlogram(firings, max_dt, labels)


def correlogram_pairs(labels: Sequence[int], mode: str, selected: Sequence[int] = (), pairs: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """The label pairs of the display modes: auto (each label with itself), selected_auto, one_vs_all (the first
    selected label with each), matrix (the selected labels with each other) and selected_pairs."""
    if mode == "auto":
        return [(k, k) for k in labels]
    if mode == "selected_auto":
        return [(k, k) for k in selected]
    if mode == "one_vs_all":
        return [(selected[0], k) for k in labels] if selected else []
    if mode == "matrix":
        return [(a, b) for a in selected for b in selected]
    if mode == "selected_pairs":
        return list(pairs)
    raise ValueError(f"no such mode: {mode}")


def correlograms(firings: DataFrame, max_dt: int, mode: str, labels: Sequence[int] = (), selected: Sequence[int] = (), pairs: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """Cross-correlograms of the label pairs of a display mode; the pairs are joined in."""
    wanted = correlogram_pairs(labels, mode, selected, pairs)
    return cross_correlogram(firings, max_dt, firings.sparkSession.createDataFrame(wanted, "label1 int, label2 int"))


def coincidence_fraction(firings: DataFrame, max_dt: int = 10, slack: int = 3) -> DataFrame:
    """label1, label2, fraction: the most events of label2 in a window of +-slack offsets around any offset
    up to max_dt, over the events of label1."""
    n1 = firings.where("label > 0").groupBy(*BY, F.col("label").alias("label1")).agg(F.count("*").alias("n1"))
    lags = cross_correlogram(firings, max_dt).where("label1 <> label2")
    # each lag adds to the windows of the offsets around it
    spread = lags.select(*BY, "label1", "label2", "n", F.explode(F.sequence(F.greatest(F.col("dt") - slack, F.lit(-max_dt)), F.least(F.col("dt") + slack, F.lit(max_dt)))).alias("at"))
    best = spread.groupBy(*BY, "label1", "label2", "at").agg(F.sum("n").alias("n")).groupBy(*BY, "label1", "label2").agg(F.max("n").alias("n"))
    return best.join(n1, [*BY, "label1"]).select(*BY, "label1", "label2", (F.col("n") / F.col("n1")).alias("fraction"))


def match_counts(firings1: DataFrame, firings2: DataFrame, max_offset: int) -> DataFrame:
    """label1, label2, n: pairs of events of positive labels at most max_offset whole samples apart."""
    joined = range_pairs(_times(firings1.where("label > 0"), "1"), _times(firings2.where("label > 0"), "2"), BY, "t1", "t2", max_offset)
    return joined.groupBy(*BY, "label1", "label2").agg(F.sum(F.col("c1") * F.col("c2")).alias("n"))


BLOCK = 1 << 16  # samples whose segments are matched together


def _segments(firings1: DataFrame, firings2: DataFrame, reach: int) -> DataFrame:
    """Both lists in one, with a block number. A segment lies between gaps of more than the reach: events of
    different segments are too far apart to meet. Segments that start in one block of samples share a group,
    since that many small groups would each cost a call."""
    both = [f.select(*BY, F.lit(s).alias("side"), "event_id", "channel", F.col("time").cast("bigint").alias("t"), "label") for s, f in ((1, firings1), (2, firings2))]
    rows = both[0].unionByName(both[1]).withColumn("span", F.floor(F.col("t") / BLOCK))
    times = carried(rows.select(*BY, "span", "t").distinct(), BY, "span", ["t"], F.col("t"), "previous", own=False)
    start = F.when(F.col("previous").isNull() | (F.col("t") - F.col("previous") > reach), F.col("t"))
    times = carried(times, BY, "span", ["t"], start, "start")
    return rows.join(times.select(*BY, "t", F.floor(F.col("start") / BLOCK).alias("segment")), [*BY, "t"]).drop("span")


_PAIRS = "recording_id string, event_id1 bigint, event_id2 bigint, channel int, t bigint, label1 int, label2 int"


def _matched(rows: DataFrame, max_offset: int, label_map: DataFrame | None) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"])
        a, b = pdf[pdf["side"] == 1], pdf[pdf["side"] == 2]
        wanted = a["wanted"].to_numpy() if "wanted" in pdf else None
        i, j = greedy_pairs(a["t"].to_numpy(), b["t"].to_numpy(), max_offset, wanted, b["label"].to_numpy())
        alone_a, alone_b = np.setdiff1d(np.arange(len(a)), i), np.setdiff1d(np.arange(len(b)), j)
        A, B = a.iloc[np.concatenate((i, alone_a)).astype(int)], b.iloc[np.concatenate((j, alone_b)).astype(int)]
        m, rec = len(i), pdf["recording_id"].iloc[0]
        out = pd.DataFrame({"recording_id": rec, "event_id1": A["event_id"].to_numpy(), "event_id2": pd.array([*B["event_id"].iloc[:m], *[None] * len(alone_a)], "Int64"), "channel": A["channel"].to_numpy(), "t": A["t"].to_numpy(), "label1": A["label"].to_numpy(), "label2": [*B["label"].iloc[:m], *[0] * len(alone_a)]})
        rest = B.iloc[m:]
        more = pd.DataFrame({"recording_id": rec, "event_id1": pd.array([None] * len(rest), "Int64"), "event_id2": rest["event_id"].to_numpy(), "channel": rest["channel"].to_numpy(), "t": rest["t"].to_numpy(), "label1": 0, "label2": rest["label"].to_numpy()})
        return pd.concat([out.astype({"event_id1": "Int64"}), more.astype({"event_id2": "Int64"})])

    if label_map is not None:
        rows = rows.join(label_map, [*BY, "label"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    return rows.groupBy(*BY, "segment").applyInPandas(run, _PAIRS)


def match_events(firings1: DataFrame, firings2: DataFrame, max_offset: int) -> DataFrame:
    """Greedy one-to-one matching of two lists, nearest first: event_id1, event_id2 (null where unmatched),
    channel, t, label1, label2 (0 where unmatched).

    A first run matches by time alone; its counts say which label of the second list each label of the
    first usually meets. The second run, which is the result, first pairs events whose labels agree with
    that, then the rest."""
    rows = _segments(firings1, firings2, max_offset)
    first = _matched(rows, max_offset, None).where("event_id1 is not null and event_id2 is not null and label1 > 0 and label2 > 0")
    count = first.groupBy(*BY, "label1", "label2").agg(F.count("*").alias("n"))
    usual = count.groupBy(*BY, F.col("label1").alias("label")).agg(F.max_by("label2", F.struct("n", -F.col("label2"))).alias("wanted"))
    return _matched(rows, max_offset, usual)


def confusion_matrix(matches: DataFrame) -> DataFrame:
    """label1, label2, n; 0 stands for unmatched."""
    return matches.groupBy(*BY, "label1", "label2").agg(F.count("*").alias("n"))


def optimal_assignment(confusion: DataFrame) -> DataFrame:
    """label1, label2: the one-to-one assignment of labels with the largest total count, per recording. A
    group is one matrix of labels by labels."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="label1", columns="label2", values="n", fill_value=0, aggfunc="sum")
        pairs = [(m.index[i], m.columns[j]) for i, j in hungarian(-m.to_numpy().astype(float)) if m.iat[i, j] > 0]
        return pd.DataFrame(pairs, columns=["label1", "label2"]).assign(recording_id=pdf["recording_id"].iloc[0])[["recording_id", "label1", "label2"]]

    return confusion.where("label1 > 0 and label2 > 0").groupBy(*BY).applyInPandas(solve, "recording_id string, label1 int, label2 int")


def merge_firings(firings1: DataFrame, firings2: DataFrame, max_offset: int, compat: bool = False) -> DataFrame:
    """Full outer matching that prefers label pairs met most often: recording_id, channel, t, label1, label2.

    All pairs within the offset are counted by labels first. In order of time each event of the first
    list then takes, of the free candidates, the one whose labels have the largest count; of equals the
    earliest. ``compat`` lets every candidate looked at add to its count, as a sequential program does;
    that couples all events of a recording, which then is one group."""
    counts = match_counts(firings1, firings2, max_offset)
    rows = _segments(firings1, firings2, max_offset)
    keys = BY if compat else [*BY, "segment"]
    schema = "recording_id string, channel int, t bigint, label1 int, label2 int"

    def run(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"])
        a, b = pdf[pdf["side"] == 1], pdf[pdf["side"] == 2]
        table = {(x, y): n for x, y, n in zip(known["label1"], known["label2"], known["n"])}
        i, j = heaviest_pairs(a["t"].to_numpy(), a["label"].to_numpy(), b["t"].to_numpy(), b["label"].to_numpy(), max_offset, table, compat)
        other = np.zeros(len(a), int)
        other[i] = b["label"].to_numpy()[j]
        rest = np.setdiff1d(np.arange(len(b)), j)
        out = pd.DataFrame({"channel": [*a["channel"], *b["channel"].iloc[rest]], "t": [*a["t"], *b["t"].iloc[rest]], "label1": [*a["label"], *[0] * len(rest)], "label2": [*other, *b["label"].iloc[rest]]})
        return out.assign(recording_id=key[0])[["recording_id", "channel", "t", "label1", "label2"]]

    needed = rows.where("side = 1").select(*keys, F.col("label").alias("label1")).distinct().join(counts, [*BY, "label1"])
    needed = needed.select(*(F.col(c).alias(c) for c in needed.columns))  # columns of its own for the cogroup
    return rows.groupBy(*keys).cogroup(needed.groupBy(*keys)).applyInPandas(run, schema)
