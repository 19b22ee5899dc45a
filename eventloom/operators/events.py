"""Filters, samples and ordered rules on firings: one row per event."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.operators.series import BY
from eventloom.runtime import Stages

SCORES = ["amplitude", "outlier_score", "detectability_score"]


def firings_view(firings: DataFrame) -> DataFrame:
    """The events behind a dirty table: repeats once, no events without a time, and zero for a missing
    label or score, as an array without that row would read."""
    scores = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in firings.columns else F.lit(0.0).alias(c) for c in SCORES]
    return firings.select("event_id", *BY, "channel", "time", F.coalesce("label", F.lit(0)).alias("label"), *scores).where("time is not null").distinct()


def detected_firings(detections: DataFrame) -> DataFrame:
    """Firings of labelled detections (recording_id, channel, time from 1, label): times index samples, ids
    are hashes of the place, so a retried task repeats them, and scores are zero."""
    return firings_view(detections.withColumn("event_id", F.xxhash64(*BY, "channel", "time")).withColumn("time", F.col("time") - 1))


def filter_events(firings: DataFrame, detectability_threshold: float = 0.0, outlier_threshold: float = 0.0) -> DataFrame:
    """Detectability at least, outlier score at most the threshold; 0 switches a test off."""
    keep = F.lit(True)
    if detectability_threshold:
        keep &= F.col("detectability_score") >= detectability_threshold
    if outlier_threshold:
        keep &= F.col("outlier_score") <= outlier_threshold
    return firings.where(keep)


def firings_subset(firings: DataFrame, labels: Sequence[int]) -> DataFrame:
    return firings.where(F.col("label").isin(*labels)) if labels else firings.limit(0)


def _ranked(firings: DataFrame, keys: list[str]) -> DataFrame:
    """rank0 (0-based in order of event_id) and n per key, with the largest group split over tasks.

    Ranks count within spans of the id first; the spans' sizes, summed up, are added."""
    cut = firings.withColumn("span", F.expr("event_id div 65536"))
    within = cut.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "span").orderBy("event_id")) - 1)
    spans = cut.groupBy(*keys, "span").agg(F.count("*").alias("size"))
    w = Window.partitionBy(*keys).orderBy("span")
    before = spans.select(*keys, "span", (F.sum("size").over(w) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy(*keys)).alias("n"))
    return within.join(before, [*keys, "span"]).withColumn("rank0", F.col("before") + F.col("place")).drop("span", "place", "before")


def subfirings(firings: DataFrame, labels: Sequence[int], max_per_label: int = 0) -> DataFrame:
    """Events of the labels, of each label and recording at most so many, evenly spaced in order of event_id:
    the ranks floor(i n / k), by whole numbers."""
    some = firings_subset(firings, labels)
    if not max_per_label:
        return some
    k = max_per_label
    rank = _ranked(some, [*BY, "label"])
    kept = F.expr(f"n <= {k} or ((rank0 * {k} + n - 1) div n) * n < (rank0 + 1) * {k}")
    return rank.where(kept).drop("rank0", "n")


def event_filter(firings: DataFrame, min_amplitude: float = 0.0, max_outlier_score: float = 0.0, min_detectability_score: float = 0.0) -> DataFrame:
    """By magnitude of amplitude and detectability and by outlier score; 0 switches a test off."""
    keep = F.lit(True)
    if min_amplitude:
        keep &= F.abs("amplitude") >= min_amplitude
    if max_outlier_score:
        keep &= F.col("outlier_score") <= max_outlier_score
    if min_detectability_score:
        keep &= F.abs("detectability_score") >= min_detectability_score
    return firings.where(keep)


def spread_sample(firings: DataFrame, n: int) -> DataFrame:
    """n events of each recording and label, first in order of sin(12 i + i^2) over the 0-based rank i."""
    rank = _ranked(firings, [*BY, "label"]).withColumn("order", F.round(F.sin(12.0 * F.col("rank0") + F.col("rank0") * F.col("rank0")), 9))
    w = Window.partitionBy(*BY, "label").orderBy("order", "rank0")
    return rank.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn", "order", "rank0", "n")


def thin(firings: DataFrame, factor: float) -> DataFrame:
    """About one event in ``factor``, chosen by the fraction of sin(i + cos i) + 5 over the rank i."""
    i = F.col("rank0").cast("double")
    x = F.sin(i + F.cos(i)) + 5
    return _ranked(firings, [*BY, "label"]).where(x - F.floor(x) <= 1.0 / factor).drop("rank0", "n")


def sort_firings(firings: DataFrame) -> DataFrame:
    """position of each event in order of time, over all recordings: a range-partitioned sort is written with
    each row's partition and place in it, and the partitions' sizes are added."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
    numbered = firings.orderBy(*BY, "time", "event_id").withColumns({"part": F.spark_partition_id(), "place": place})
    numbered = Stages(firings.sparkSession, "sorted").write(numbered)
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per partition
    return numbered.join(F.broadcast(before), "part").withColumn("position", F.col("before") + F.col("place")).drop("part", "place", "before")


def visible(clusters: DataFrame, subset: Sequence[int] = (), tags: Sequence[str] = (), untagged: bool = False) -> DataFrame:
    """Clusters (label, tags) to be shown: in the subset if there is one, not rejected, and, where tags or
    ``untagged`` ask for it, with one of the tags or with none."""
    held = F.coalesce("tags", F.array().cast("array<string>"))
    keep = ~F.array_contains(held, "rejected")
    if subset:
        keep &= F.col("label").isin(*subset)
    if tags or untagged:
        wanted = F.arrays_overlap(held, F.array(*map(F.lit, tags))) if tags else F.lit(False)
        keep &= wanted | ((F.size(held) == 0) if untagged else F.lit(False))
    return clusters.where(keep)


def curated_export(firings: DataFrame, clusters: DataFrame, merges: DataFrame) -> DataFrame:
    """Events without those of rejected clusters, labelled by their merge group's representative.
    ``merges`` has (label, representative)."""
    bad = clusters.where(F.array_contains("tags", "rejected")).select("label").distinct()
    kept = firings.join(bad, "label", "left_anti").join(merges, "label", "left")
    return kept.withColumn("label", F.coalesce("representative", "label")).drop("representative")


def relabel_dense(firings: DataFrame) -> DataFrame:
    """Labels in use renumbered 1, 2, ... per recording; label 0 stays."""
    used = firings.where("label > 0").select(*BY, "label").distinct()
    new = used.withColumn("new", F.row_number().over(Window.partitionBy(*BY).orderBy("label")))
    return firings.join(new, [*BY, "label"], "left").withColumn("label", F.coalesce("new", F.lit(0))).drop("new")


def sign_split(firings: DataFrame) -> DataFrame:
    return firings.withColumn("side", F.when(F.col("amplitude") < 0, "negative").otherwise("positive"))


def remove_redundant(firings: DataFrame, max_dt: float = 5.0, cut: float = 65536.0) -> DataFrame:
    """Events of a label at most max_dt after the label's previous event (kept or not) are dropped.

    Labels are cut by time, so that a hot one is split; an event near the start of a cut finds its
    predecessor there as well."""
    span = F.floor(F.col("time") / cut)
    late = F.col("time") - span * cut
    own = firings.withColumn("span", span).withColumn("guest", F.lit(False))
    guests = firings.where(cut - late <= max_dt).withColumn("span", span + 1).withColumn("guest", F.lit(True))
    w = Window.partitionBy(*BY, "label", "span").orderBy("time", "event_id")
    both = own.unionByName(guests).withColumn("before", F.lag("time").over(w))
    return both.where(~F.col("guest") & (F.col("before").isNull() | (F.col("time") - F.col("before") > max_dt))).drop("span", "guest", "before")


def events_to_use(firings: DataFrame, score: str, reach: float) -> DataFrame:
    """Events of positive score that no event within +-reach beats; of equal scores the later loses to the
    earlier (by time, then event_id). A range self-join by buckets of the reach: with pre-aggregated
    maxima, a bucket sends its neighbours what can beat them."""
    from eventloom.operators.joins import range_pairs

    a = firings.where(F.col(score) > 0).select(*BY, "event_id", "time", F.col(score).alias("score"))
    b = a.select(*BY, F.col("event_id").alias("other"), F.col("time").alias("other_time"), F.col("score").alias("other_score"))
    pairs = range_pairs(a, b, BY, "time", "other_time", reach).where("other <> event_id")
    earlier = F.struct("other_time", "other") < F.struct(F.col("time").alias("other_time"), F.col("event_id").alias("other"))
    beaten = pairs.where((F.col("other_score") > F.col("score")) | ((F.col("other_score") == F.col("score")) & earlier))
    return firings.where(F.col(score) > 0).join(beaten.select("event_id").distinct(), "event_id", "left_anti")


def carried(rows: DataFrame, keys: list[str], span: str, order: list[str], value: Column, name: str, own: bool = True) -> DataFrame:
    """Adds the last value, of values that do not fall in the order, at each row or before it (before it only
    unless ``own``). Keys are cut by the column ``span``, which grows with the order: the values of the spans
    before are summed up in one row a span, so no key is one task's work."""
    w = Window.partitionBy(*keys, span).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    within = rows.withColumn("_value", value).withColumn("_within", F.last("_value", ignorenulls=True).over(w))
    ends = rows.groupBy(*keys, span).agg(F.max(value).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, span, F.max("_end").over(earlier).alias("_before"))
    return within.join(ends, [*keys, span]).withColumn(name, F.coalesce("_within", "_before")).drop("_value", "_within", "_before")


def refractory(firings: DataFrame, period: float, cut: float = 65536.0) -> DataFrame:
    """Of each label's events in order of time (then event_id) those at least ``period`` after the last kept one.

    After a gap of the period an event is kept whatever went before, so labels fall into pieces between such
    gaps, which are scanned apart: one pass over each piece, with the last kept time as all that is held."""
    keys = [*BY, "label"]
    rows = firings.select(*keys, "time", "event_id").withColumn("span", F.floor(F.col("time") / cut))
    rows = carried(rows, keys, "span", ["time", "event_id"], F.col("time"), "previous", own=False)
    start = F.when(F.col("previous").isNull() | (F.col("time") - F.col("previous") >= period), F.col("time"))
    rows = carried(rows, keys, "span", ["time", "event_id"], start, "piece")
    piece = F.xxhash64(*keys, "piece")
    ordered = rows.select(piece.alias("g"), *keys, "piece", "time", "event_id").repartition("g").sortWithinPartitions("g", *keys, "piece", "time", "event_id")
    kept = ordered.select("g", "piece", "time", "event_id").mapInArrow(_spaced(period), "event_id bigint")
    return firings.join(kept, "event_id", "left_semi")


def _spaced(period: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0.0
        for b in batches:
            keep = []
            for g, piece, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                fine = (g, piece) != key or t - last >= period
                if fine:
                    key, last = (g, piece), t
                keep.append(fine)
            yield pa.RecordBatch.from_arrays([b.column(3).filter(pa.array(keep, pa.bool_()))], names=["event_id"])

    return run


def in_epochs(firings: DataFrame, epochs: DataFrame, samples_per_unit: float = 1.0) -> DataFrame:
    """event_id with the names of the epochs (recording_id, name, t_begin, t_end) it lies in."""
    at = F.col("time") / samples_per_unit
    return firings.join(epochs, BY).where((at >= F.col("t_begin")) & (at < F.col("t_end"))).select("event_id", "name")


def parse_epochs(lines: DataFrame) -> DataFrame:
    """name, t_begin, t_end of text lines "EPOCH name t_begin t_end"; times stored from 0."""
    part = F.split(F.trim("value"), r"\s+")
    return lines.where(part[0] == "EPOCH").select(part[1].alias("name"), (part[2].cast("double") - 1).alias("t_begin"), (part[3].cast("double") - 1).alias("t_end"))


def histogram_bin(v: Column, left: float, right: float, n: int) -> Column:
    """1..n; a value on an inner edge belongs to the lower bin; null outside."""
    width = (right - left) / n
    return F.when((v >= left) & (v <= right), F.greatest(F.lit(1), F.least(F.lit(n), F.ceil((v - left) / width))).cast("int"))
