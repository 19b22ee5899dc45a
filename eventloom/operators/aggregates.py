"""Templates and other aggregates by label, channel and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.events import histogram_bin
from eventloom.operators.joins import _windows, extract_clips
from eventloom.operators.series import BY

LABEL = [*BY, "label"]


def compute_templates(series: DataFrame, firings: DataFrame, clip_size: int, compat: bool = False) -> DataFrame:
    """recording_id, label, channel, dt, mean, stdev, n: the mean clip of each positive label, over all its
    events; times round to the nearest sample, samples that are missing or outside count as zero.

    ``stdev`` is the population deviation where there are at least two events, else 0. ``compat`` divides by
    n + label - 1 instead of n. Only samples that exist are joined; sums combine before the shuffle."""
    f = firings.where("label > 0").select(*LABEL, "event_id", "time")
    n = f.groupBy(*LABEL).agg(F.count("*").alias("n"))
    channels = series.select(*BY, "channel").distinct()
    places = _windows(f, clip_size, rounded=True).select(*LABEL, "dt", "t")
    sums = places.join(series, [*BY, "t"]).groupBy(*LABEL, "channel", "dt").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    grid = n.join(channels, BY).withColumn("dt", F.explode(F.sequence(F.lit(0), F.lit(clip_size - 1))))
    divisor = (F.col("n") + F.col("label") - 1) if compat else F.col("n")
    s, ss = F.coalesce("s", F.lit(0.0)), F.coalesce("ss", F.lit(0.0))
    mean = s / divisor
    deviation = F.when(divisor >= 2, F.sqrt(F.greatest(ss / divisor - mean * mean, F.lit(0.0)))).otherwise(0.0)
    return grid.join(sums, [*LABEL, "channel", "dt"], "left").select(*LABEL, "channel", "dt", mean.alias("mean"), deviation.alias("stdev"), "n")


def peak_place(templates: DataFrame) -> DataFrame:
    """recording_id, label, channel, dt, peak: where the magnitude of a label's template is largest; of equal
    places the first in order of dt, then channel."""
    order = F.struct(F.abs("mean"), -F.col("dt"), -F.col("channel"))
    return templates.groupBy(*LABEL).agg(F.max_by(F.struct("channel", "dt", F.col("mean").alias("peak")), order).alias("p")).select(*LABEL, "p.*")


def compute_amplitudes(series: DataFrame, firings: DataFrame, clip_size: int = 40) -> DataFrame:
    """event_id, amplitude: each event's clip at the place where its label's template peaks. Only that
    sample of each event is joined, not its clip."""
    place = peak_place(compute_templates(series, firings, clip_size)).select(*LABEL, F.col("channel").alias("peak_channel"), "dt")
    size = series.groupBy(*BY).agg((F.max("t") + 1).alias("size"))
    mid = (clip_size + 1) // 2 - 1
    at = firings.where("label > 0").select("event_id", *LABEL, F.col("time").cast("bigint").alias("t0")).join(place, LABEL).join(size, BY)
    at = at.select("event_id", *BY, F.col("peak_channel").alias("channel"), (F.col("t0") - mid + F.col("dt")).alias("t"), ((F.col("t0") >= mid) & (F.col("t0") - mid + clip_size <= F.col("size"))).alias("inside"))
    return at.join(series, [*BY, "channel", "t"], "left").select("event_id", F.when(F.col("inside"), F.coalesce("value", F.lit(0.0))).otherwise(0.0).alias("amplitude"))


def basic_metrics(series: DataFrame, firings: DataFrame, recordings: DataFrame, labels: list[int] | None = None) -> DataFrame:
    """recording_id, label, num_events, firing_rate (per second); with ``labels`` those, also without events."""
    rate = recordings.groupBy(*BY).agg(F.max("samplerate").alias("samplerate"))
    size = series.groupBy(*BY).agg((F.max("t") + 1).alias("size"))
    n = firings.groupBy(*LABEL).agg(F.count("*").alias("num_events"))
    if labels is not None:
        n = size.select(*BY, F.explode(F.array(*map(F.lit, labels))).alias("label")).join(n, LABEL, "left").fillna(0, ["num_events"])
    return n.join(size, BY).join(rate, BY).select(*LABEL, "num_events", (F.col("num_events") * F.col("samplerate") / F.col("size")).alias("firing_rate"))


def channel_peaks(templates: DataFrame) -> DataFrame:
    """recording_id, label, channel, peak: the signed value of largest magnitude per channel, the first of equals."""
    return templates.groupBy(*LABEL, "channel").agg(F.max_by("mean", F.struct(F.abs("mean"), -F.col("dt"))).alias("peak"))


def channel_energy(templates: DataFrame) -> DataFrame:
    return templates.groupBy(*LABEL, "channel").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("energy"))


def histogram(values: DataFrame, column: str, left: float, right: float, n_bins: int, by: list[str] | None = None) -> DataFrame:
    """bin (1..n), count, density of the values inside [left, right]."""
    keys = by or []
    binned = values.withColumn("bin", histogram_bin(F.col(column), left, right, n_bins)).where("bin is not null")
    count = binned.groupBy(*keys, "bin").agg(F.count("*").alias("count"))
    return count.withColumn("density", F.col("count") / ((right - left) / n_bins))


def amplitude_order(firings: DataFrame) -> DataFrame:
    """recording_id, label, median, position: labels by the magnitude of their median amplitude."""
    from pyspark.sql.window import Window

    m = firings.where("label > 0").groupBy(*LABEL).agg(F.median("amplitude").alias("median"))
    return m.withColumn("position", F.row_number().over(Window.partitionBy(*BY).orderBy(F.abs("median"), "label")))


def cluster_order(clusters: DataFrame, score: str | None = None) -> DataFrame:
    """recording_id, label, position: labels in ascending order of a score, equal ones by label; without a score
    by label alone. Labels whose score is missing come last."""
    from pyspark.sql.window import Window

    order = [F.col(score).asc_nulls_last()] if score else []
    return clusters.select(*LABEL, F.row_number().over(Window.partitionBy(*BY).orderBy(*order, "label")).alias("position"))


def cluster_detail(templates: DataFrame) -> DataFrame:
    """recording_id, label, num_events, channels, mean, stdev (by dt, then channel) of each label with events."""
    rows = F.sort_array(F.collect_list(F.struct("dt", "channel", "mean", "stdev")))
    flat = templates.where("n > 0").groupBy(*LABEL).agg(F.max("n").alias("num_events"), F.sort_array(F.collect_set("channel")).alias("channels"), rows.alias("r"))
    return flat.select(*LABEL, "num_events", "channels", F.transform("r", lambda x: x["mean"]).alias("mean"), F.transform("r", lambda x: x["stdev"]).alias("stdev"))


def upsert_metrics(attributes: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metrics (map): the attributes' metrics with those of a table (keys and one column a metric) put over
    them. Keys that only one side has are kept; a metric that is null leaves the old one."""
    names = [c for c in metrics.columns if c not in keys]
    new = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("double") for c in names))), lambda _, v: v.isNotNull())
    none = F.create_map().cast("map<string,double>")
    both = attributes.select(*keys, F.col("metrics").alias("old")).join(metrics.select(*keys, new.alias("new")), keys, "full")
    old, put = F.coalesce("old", none), F.coalesce("new", none)
    return both.select(*keys, F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(put, k)), put).alias("metrics"))


def centredness(templates: DataFrame, clip_size: int) -> DataFrame:
    """recording_id, label, centredness, quality: 1 - |com - T/2| / (T/2) over the magnitudes of the template,
    and the norm of the template over that of its deviations, plus centredness."""
    weight = F.abs("mean")
    com = F.sum(weight * F.col("dt")) / F.nullif(F.sum(weight), F.lit(0.0))
    c = F.coalesce(1 - F.abs((com - clip_size / 2) / (clip_size / 2)), F.lit(0.0))
    norm = lambda x: F.sqrt(F.sum(F.col(x) * F.col(x)))
    ratio = F.coalesce(norm("mean") / F.nullif(norm("stdev"), F.lit(0.0)), F.lit(0.0))
    return templates.groupBy(*LABEL).agg(c.alias("centredness"), (ratio + c).alias("quality"))


def confusion_normalized(confusion: DataFrame) -> DataFrame:
    """row_share and column_share of each count."""
    rows = confusion.groupBy(*BY, "label1").agg(F.sum("n").alias("row_n"))
    columns = confusion.groupBy(*BY, "label2").agg(F.sum("n").alias("column_n"))
    return confusion.join(rows, [*BY, "label1"]).join(columns, [*BY, "label2"]).select(*BY, "label1", "label2", "n", (F.col("n") / F.col("row_n")).alias("row_share"), (F.col("n") / F.col("column_n")).alias("column_share"))


def confusion_order(confusion: DataFrame) -> DataFrame:
    """recording_id, label1, fraction, position: labels by the share of their events on their best match, rows without events last."""
    from pyspark.sql.window import Window

    f = confusion.where("label1 > 0").groupBy(*BY, "label1").agg((F.max(F.when(F.col("label2") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("fraction"))
    return f.withColumn("position", F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("fraction"), "label1")))


def accuracy_table(confusion: DataFrame, assignment: DataFrame) -> DataFrame:
    """Per true label: n_true, n_detected (of the assigned label), n_correct, n_incorrect, n_extra, n_missed
    and accuracy = correct / (correct + incorrect + extra + missed)."""
    a = assignment.withColumnRenamed("label2", "match")
    rows = confusion.where("label1 > 0").join(a, [*BY, "label1"], "left")
    right = F.col("label2") == F.coalesce("match", F.lit(-1))
    per = rows.groupBy(*BY, "label1").agg(
        F.max("match").alias("match"), F.sum("n").alias("n_true"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("n_correct"),
        F.sum(F.when(~right & (F.col("label2") > 0), F.col("n")).otherwise(0)).alias("n_incorrect"), F.sum(F.when(F.col("label2") == 0, F.col("n")).otherwise(0)).alias("n_missed"),
    )
    extra = confusion.where("label1 = 0").select(*BY, F.col("label2").alias("match"), F.col("n").alias("extra"))
    found = confusion.where("label2 > 0").groupBy(*BY, F.col("label2").alias("match")).agg(F.sum("n").alias("detected"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = per.join(extra, [*BY, "match"], "left").join(found, [*BY, "match"], "left").withColumns({"n_extra": zero(F.col("extra")), "n_detected": zero(F.col("detected"))})
    return out.select(*BY, "label1", "n_true", "n_detected", "n_correct", "n_incorrect", "n_extra", "n_missed", (F.col("n_correct") / (F.col("n_true") + F.col("n_extra"))).alias("accuracy"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's; null where one side is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def scalar_aggregates(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """min, max, sum, mean, median, sample deviation, norm, dot product and correlation of two columns;
    zero where the number of values leaves one undefined."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    a, b = F.col(x), F.col(y)
    return df.groupBy(*by).agg(
        F.min(a).alias("vmin"), F.max(a).alias("vmax"), zero(F.sum(a)).alias("total"), zero(F.avg(a)).alias("mean"), zero(F.median(a)).alias("median"),
        zero(F.stddev_samp(a)).alias("sd"), zero(F.sqrt(F.sum(a * a))).alias("norm"), zero(F.sum(a * b)).alias("dot"), zero(correlation(a, b)).alias("correlation"),
    )


def full_templates(series: DataFrame, firings: DataFrame, clip_size: int) -> DataFrame:
    """Mean and population deviation of clips that are zero as a whole at the ends."""
    clips = extract_clips(series, firings.where("label > 0"), clip_size)
    return clips.join(firings.select("event_id", "label"), "event_id").groupBy(*LABEL, "channel", "dt").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("stdev"), F.count("*").alias("n"))
