"""Scores of clusters and pairs of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.kernels.features import nearest, neighbour_overlap, principal_components
from eventloom.kernels.svm import linear_svm
from eventloom.operators.aggregates import LABEL, compute_templates, correlation, full_templates, peak_place
from eventloom.operators.events import spread_sample
from eventloom.operators.features import components
from eventloom.operators.joins import clip_vectors, extract_clips
from eventloom.operators.series import BY
from eventloom.runtime import Stages

NEIGHBOURS, FEATURES, SAMPLE = 6, 10, 500  # fixed values of the overlap metrics


def peak_metrics(templates: DataFrame) -> DataFrame:
    """recording_id, label, peak_amp (largest magnitude of the template), peak_noise (largest deviation)."""
    return templates.groupBy(*LABEL).agg(F.max(F.abs("mean")).alias("peak_amp"), F.max("stdev").alias("peak_noise"))


def _pairs(templates: DataFrame) -> DataFrame:
    a = templates.select(*LABEL, "channel", "dt", "mean")
    b = a.select(*BY, F.col("label").alias("label2"), "channel", "dt", F.col("mean").alias("mean2"))
    return a.withColumnRenamed("label", "label1").join(b, [*BY, "channel", "dt"])


def template_distances(templates: DataFrame) -> DataFrame:
    """recording_id, label1, label2, distance between the templates of two labels of a recording."""
    d = F.col("mean") - F.col("mean2")
    return _pairs(templates).where("label1 <> label2").groupBy(*BY, "label1", "label2").agg(F.sqrt(F.sum(d * d)).alias("distance"))


def nearest_templates(templates: DataFrame, k: int) -> DataFrame:
    """The k nearest labels of each label, with their rank."""
    w = Window.partitionBy(*BY, "label1").orderBy(F.round("distance", 6), "label2")
    return template_distances(templates).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pairs_to_compare(templates: DataFrame, most: int) -> DataFrame:
    """recording_id, label1, label2, distance, rank: of each label the nearest later ones, at most so many."""
    w = Window.partitionBy(*BY, "label1").orderBy(F.round("distance", 6), "label2")
    return template_distances(templates).where("label1 < label2").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def template_similarity(templates: DataFrame, norm_ratio: float = 0.8) -> DataFrame:
    """recording_id, label1 < label2, similarity: Pearson correlation of the templates; zero where the
    smaller norm is under ``norm_ratio`` of the larger, or where one is constant."""
    p = _pairs(templates).where("label1 < label2")
    n1, n2 = F.sqrt(F.sum(F.col("mean") * F.col("mean"))), F.sqrt(F.sum(F.col("mean2") * F.col("mean2")))
    r = F.coalesce(correlation(F.col("mean"), F.col("mean2")), F.lit(0.0))
    near = F.least(n1, n2) >= norm_ratio * F.greatest(n1, n2)
    return p.groupBy(*BY, "label1", "label2").agg(F.when(near, r).otherwise(0.0).alias("similarity"))


def discriminant_values(clips: DataFrame, firings: DataFrame, pairs: DataFrame) -> DataFrame:
    """recording_id, k1, k2, k, event_id, value: clips of both labels of each pair (recording_id, k1, k2),
    projected on the difference of their centroids: 0 at the middle, the centroids at -1/2 and 1/2."""
    rows = clips.join(firings.select("event_id", "label"), "event_id")
    centroid = rows.groupBy(*LABEL, "channel", "dt").agg(F.avg("value").alias("m"))
    c1 = pairs.join(centroid.withColumnsRenamed({"label": "k1", "m": "m1"}), [*BY, "k1"])
    axis = c1.join(centroid.withColumnsRenamed({"label": "k2", "m": "m2"}), [*BY, "k2", "channel", "dt"])
    axis = axis.select(*BY, "k1", "k2", "channel", "dt", (F.col("m2") - F.col("m1")).alias("d"), ((F.col("m1") + F.col("m2")) / 2).alias("mid"))
    labelled = axis.withColumn("label", F.explode(F.array("k1", "k2"))).join(rows, [*LABEL, "channel", "dt"])
    projected = labelled.groupBy(*BY, "k1", "k2", F.col("label").alias("k"), "event_id").agg(F.sum((F.col("value") - F.col("mid")) * F.col("d")).alias("s"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    return projected.select(*BY, "k1", "k2", "k", "event_id", F.coalesce(F.col("s") / F.nullif("dd", F.lit(0.0)), F.lit(0.0)).alias("value"))


def _svm_axes(x: DataFrame, firings: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """recording_id, k1, k2, d, cut, norm: each pair's direction and cut, of a machine fitted on at most ``most``
    events of each label, evenly spread; k1 lies below the cut."""
    chosen = spread_sample(firings.join(pairs.select(*BY, F.explode(F.array("k1", "k2")).alias("label")).distinct(), LABEL, "left_semi"), most).select("event_id")
    rows = pairs.withColumn("label", F.explode(F.array("k1", "k2"))).join(x.join(chosen, "event_id", "left_semi"), LABEL)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "event_id"])
        first = pdf.iloc[:1][["recording_id", "k1", "k2"]]
        side = np.where(pdf["label"].to_numpy() == first["k2"].iloc[0], 1.0, -1.0)
        direction, cut = linear_svm(np.array(pdf["x"].tolist()), side)
        return first.assign(d=[direction.tolist()], cut=cut, norm=float(direction @ direction))

    return rows.select(*BY, "k1", "k2", "label", "event_id", "x").groupBy(*BY, "k1", "k2").applyInPandas(fit, "recording_id string, k1 int, k2 int, d array<double>, cut double, norm double")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def svm_values(clips: DataFrame, firings: DataFrame, pairs: DataFrame, most: int = 1000) -> DataFrame:
    """Like ``discriminant_values`` along the direction of a linear support vector machine, 0 at its cut.

    Each pair's machine is fitted on at most ``most`` events of each label, evenly spread; all are projected."""
    x = _vectors(clips).join(firings.select("event_id", "label"), "event_id")
    each = _svm_axes(x, firings, pairs, most).withColumn("label", F.explode(F.array("k1", "k2"))).join(x, LABEL)
    value = F.coalesce((_dot("x", "d") - F.col("cut")) / F.nullif("norm", F.lit(0.0)), F.lit(0.0))
    return each.select(*BY, "k1", "k2", F.col("label").alias("k"), "event_id", value.alias("value"))


def _compared(series: DataFrame, firings: DataFrame, clip_size: int, most_comparisons: int, noise_level: float, most: int, seed: int) -> DataFrame:
    """recording_id, k1, k2, k, event_id, value and wrong (whether the event, with a random window of the series
    added to its clip, falls on the other side) of the pairs of nearest later labels."""
    pairs = pairs_to_compare(compute_templates(series, firings, clip_size), most_comparisons).select(*BY, F.col("label1").alias("k1"), F.col("label2").alias("k2"))
    pairs = Stages(series.sparkSession, "compared").write(pairs)
    used = firings.join(pairs.select(*BY, F.explode(F.array("k1", "k2")).alias("label")).distinct(), LABEL, "left_semi").select("event_id", *LABEL, "time")
    noise = _random_vectors(series, used, clip_size, seed).select("event_id", F.col("x").alias("noise"))
    x = clip_vectors(series, used, clip_size).join(used.select("event_id", "label"), "event_id")
    each = _svm_axes(x, used, pairs, most).withColumn("label", F.explode(F.array("k1", "k2"))).join(x.join(noise, "event_id"), LABEL)
    plain = _dot("x", "d") - F.col("cut")
    noised = plain + noise_level * _dot("noise", "d")
    wrong = F.when(F.col("label") == F.col("k1"), noised > 0).otherwise(noised < 0)
    return each.select(*BY, "k1", "k2", F.col("label").alias("k"), "event_id", F.coalesce(plain / F.nullif("norm", F.lit(0.0)), F.lit(0.0)).alias("value"), wrong.alias("wrong"))


def cluster_pair_scores(series: DataFrame, firings: DataFrame, clip_size: int, most_comparisons: int = 10, noise_level: float = 1.0, most: int = 1000, seed: int = 0) -> DataFrame:
    """recording_id, k1, k2, score: of the pairs of each label and its nearest later ones the share of events that
    a linear support vector machine, fitted on clean clips, takes for the other label once noise is added."""
    each = _compared(series, firings, clip_size, most_comparisons, noise_level, most, seed)
    return each.groupBy(*BY, "k1", "k2").agg(F.avg(F.col("wrong").cast("double")).alias("score"))


def histogram_guide2(series: DataFrame, firings: DataFrame, clip_size: int, most_comparisons: int = 10, noise_level: float = 1.0, most: int = 1000, seed: int = 0) -> DataFrame:
    """recording_id, position, k1, k2, k, event_id, value: the clean projections of the pairs compared, the pair
    that noise confuses most first."""
    each = Stages(series.sparkSession, "guide").write(_compared(series, firings, clip_size, most_comparisons, noise_level, most, seed))
    score = each.groupBy(*BY, "k1", "k2").agg(F.avg(F.col("wrong").cast("double")).alias("score"))
    place = score.select(*BY, "k1", "k2", F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc(F.round("score", 9)), "k1", "k2")).alias("position"))
    return each.join(place, [*BY, "k1", "k2"]).select(*BY, "position", "k1", "k2", "k", "event_id", "value")


def separation(values: DataFrame) -> DataFrame:
    """recording_id, k1, k2, score: the distance of the two labels' means over the deviation of the residuals."""
    per = values.groupBy(*BY, "k1", "k2", "k").agg(F.avg("value").alias("m"))
    res = values.join(per, [*BY, "k1", "k2", "k"]).groupBy(*BY, "k1", "k2").agg(F.stddev_samp(F.col("value") - F.col("m")).alias("sd"), F.max(F.when(F.col("k") == F.col("k1"), F.col("m"))).alias("m1"), F.max(F.when(F.col("k") == F.col("k2"), F.col("m"))).alias("m2"))
    return res.select(*BY, "k1", "k2", F.coalesce(F.abs(F.col("m2") - F.col("m1")) / F.nullif("sd", F.lit(0.0)), F.lit(0.0)).alias("score"))


def histogram_guide(series: DataFrame, firings: DataFrame, num_histograms: int, clip_size: int) -> DataFrame:
    """The pairs that are hardest to tell apart: of the 2n pairs of nearest templates of each recording the n
    of the least separation."""
    templates = compute_templates(series, firings, clip_size)
    w = Window.partitionBy(*BY).orderBy(F.round("distance", 6), "label1", "label2")
    near = template_distances(templates).where("label1 < label2 and distance > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2 * num_histograms)
    pairs = near.select(*BY, F.col("label1").alias("k1"), F.col("label2").alias("k2"))
    used = firings.join(pairs.select(*BY, F.explode(F.array("k1", "k2")).alias("label")).distinct(), LABEL, "left_semi")
    score = separation(discriminant_values(extract_clips(series, used, clip_size), used, pairs))
    by_score = Window.partitionBy(*BY).orderBy(F.round("score", 6), "k1", "k2")
    return score.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= num_histograms)


def _vectors(clips: DataFrame) -> DataFrame:
    return clips.groupBy(*BY, "event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dt", "channel", "value"))), lambda s: s["value"]).alias("x"))


def _random_places(series: DataFrame, sample: DataFrame, clip_size: int, seed: int) -> DataFrame:
    size = series.groupBy(*BY).agg((F.max("t") + 1).alias("n"))
    room = F.greatest(F.col("n") - 2 * clip_size, F.lit(1))
    return sample.join(size, BY).select("event_id", *BY, (clip_size + F.pmod(F.xxhash64("event_id", F.lit(seed)), room)).cast("double").alias("time"))


def _random_clips(series: DataFrame, sample: DataFrame, clip_size: int, seed: int) -> DataFrame:
    """As many windows of each label as it has events, at places drawn by hash."""
    return extract_clips(series, _random_places(series, sample, clip_size, seed), clip_size)


def _random_vectors(series: DataFrame, sample: DataFrame, clip_size: int, seed: int) -> DataFrame:
    return clip_vectors(series, _random_places(series, sample, clip_size, seed), clip_size)


def noise_overlap(series: DataFrame, firings: DataFrame, clip_size: int, seed: int = 0) -> DataFrame:
    """recording_id, label, noise_overlap: of at most 500 events of a label and as many random windows, in
    ten principal components, the share of near neighbours of the other kind."""
    sample = spread_sample(firings.where("label > 0"), SAMPLE).select("event_id", *LABEL)
    own = clip_vectors(series, firings.join(sample.select("event_id"), "event_id", "left_semi"), clip_size).withColumn("kind", F.lit(1))
    noise = _random_vectors(series, sample, clip_size, seed).withColumn("kind", F.lit(0))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "event_id"])
        x, kind = np.array(pdf["x"].tolist()), pdf["kind"].to_numpy()
        value = neighbour_overlap(principal_components(x, FEATURES)[1], kind, NEIGHBOURS)
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[:1], "label": pdf["label"].iloc[:1], "noise_overlap": [value]})

    both = own.unionByName(noise).join(sample, [*BY, "event_id"])
    return both.groupBy(*LABEL).applyInPandas(score, "recording_id string, label int, noise_overlap double")


def cluster_metrics(series: DataFrame, firings: DataFrame, clip_size: int) -> DataFrame:
    """recording_id, label, noise_overlap, peak_amp, peak_noise of each positive label."""
    return peak_metrics(compute_templates(series, firings, clip_size)).join(noise_overlap(series, firings, clip_size), LABEL, "left").select(*LABEL, "noise_overlap", "peak_amp", "peak_noise")


def pair_overlap(series: DataFrame, firings: DataFrame, clip_size: int, nearest: int = 5, least: int = 100) -> DataFrame:
    """recording_id, label1, label2, overlap of each label with its nearest ones; zero under ``least`` events,
    and values under 0.01 are zero. Zero rows are left out."""
    templates = compute_templates(series, firings, clip_size)
    pairs = nearest_templates(templates, nearest).select(*BY, "label1", "label2")
    sample = spread_sample(firings.where("label > 0"), SAMPLE).select("event_id", *LABEL)
    many = sample.groupBy(*LABEL).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*LABEL)
    for end in ("label1", "label2"):
        pairs = pairs.join(many.withColumnRenamed("label", end), [*BY, end], "left_semi")
    sample = sample.join(many, LABEL, "left_semi")
    x = clip_vectors(series, firings.join(sample.select("event_id"), "event_id", "left_semi"), clip_size).join(sample, [*BY, "event_id"])
    rows = pairs.withColumn("label", F.explode(F.array("label1", "label2"))).join(x, LABEL)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1]
        kinds = [pdf[pdf["label"] == first[c].iloc[0]].sort_values("event_id") for c in ("label1", "label2")]
        n = min(SAMPLE, len(kinds[0]), len(kinds[1]))
        value = 0.0
        if n >= least:
            both = pd.concat([k.iloc[:n] for k in kinds])
            value = neighbour_overlap(principal_components(np.array(both["x"].tolist()), FEATURES)[1], both["label"].to_numpy(), NEIGHBOURS)
        return first[["recording_id", "label1", "label2"]].assign(overlap=value if value >= 0.01 else 0.0)

    return rows.groupBy(*BY, "label1", "label2").applyInPandas(score, "recording_id string, label1 int, label2 int, overlap double").where("overlap > 0")


def cluster_scores(series: DataFrame, firings: DataFrame, clip_size: int, detect_threshold: float, noise_level: float = 1.0, seed: int = 0) -> DataFrame:
    """recording_id, label, score: the share of events that, with a random window of the series added to
    them, fall under the threshold at their template's peak (taken with its sign)."""
    place = peak_place(compute_templates(series, firings, clip_size))
    f = firings.where("label > 0").select("event_id", *LABEL, "time")
    clips = extract_clips(series, f, clip_size)
    noise = _random_clips(series, f, clip_size, seed).withColumnRenamed("value", "noise")
    at = clips.join(f.select("event_id", "label"), "event_id").join(place, [*LABEL, "channel", "dt"]).join(noise, [*BY, "event_id", "channel", "dt"])
    noised = (F.col("value") + noise_level * F.col("noise")) * F.signum("peak")
    return at.groupBy(*LABEL).agg(F.avg(F.when(noised < detect_threshold, 1.0).otherwise(0.0)).alias("score"))


def define_shells(firings: DataFrame, increment: float, min_size: int) -> DataFrame:
    """event_id, shell: amplitudes of each label and sign in steps of ``increment``, steps joined until a
    shell and what lies above it both have ``min_size`` events; the last shell has the rest. Negative
    amplitudes have negative shells. Steps are counted first, so what is folded in order is one number per
    step, not per event. ``increment`` 0 gives one shell.
    """
    side = F.when(F.col("amplitude") < 0, -1).otherwise(1)
    step = F.floor(F.abs("amplitude") / increment) if increment > 0 else F.lit(0).cast("bigint")
    rows = firings.select("event_id", *LABEL, side.alias("side"), step.alias("step"))
    steps = rows.groupBy(*LABEL, "side", "step").agg(F.count("*").alias("n"))
    whole = steps.groupBy(*LABEL, "side").agg(F.sort_array(F.collect_list(F.struct("step", "n"))).alias("steps"), F.sum("n").alias("total"))
    start = F.struct(F.col("total").alias("above"), F.lit(0).cast("bigint").alias("inside"), F.lit(1).alias("shell"), F.array().cast("array<struct<step:bigint,shell:int>>").alias("out"))

    def fold(s, x):
        above, inside = s["above"] - x["n"], s["inside"] + x["n"]
        cut = (inside >= min_size) & (above >= min_size) & (above > 0)
        zero = F.lit(0).cast("bigint")
        placed = F.array(F.struct(x["step"].alias("step"), s["shell"].alias("shell")))
        return F.struct(above.alias("above"), F.when(cut, zero).otherwise(inside).alias("inside"), F.when(cut, s["shell"] + 1).otherwise(s["shell"]).alias("shell"), F.concat(s["out"], placed).alias("out"))

    shells = whole.select(*LABEL, "side", F.inline(F.aggregate("steps", start, fold)["out"]))
    return rows.join(shells, [*LABEL, "side", "step"]).select("event_id", *LABEL, (F.col("shell") * F.col("side")).alias("shell"))


def split_into_shells(firings: DataFrame, increment: float, min_size: int) -> DataFrame:
    """Firings with a label of their own for each shell, numbered per recording; original_label keeps the old."""
    shells = define_shells(firings.where("label > 0"), increment, min_size)
    used = shells.select(*LABEL, "shell").distinct()
    new = used.withColumn("new", F.row_number().over(Window.partitionBy(*BY).orderBy("label", "shell")))
    out = firings.join(shells.join(new, [*LABEL, "shell"]).select("event_id", "new"), "event_id")
    return out.withColumn("original_label", F.col("label")).withColumn("label", F.col("new")).drop("new")


def outlier_scores(series: DataFrame, firings: DataFrame, clip_size: int, shell_increment: float, min_shell_size: int, noise_clips: int = 5000, sigma: float = 6.0) -> DataFrame:
    """event_id, outlier_score: an event's squared distance from its shell's mean clip, weighted by the
    smoothed magnitude of that mean, as a z-score among evenly spaced windows of the series around zero."""
    split = split_into_shells(firings, shell_increment, min_shell_size)
    clips = extract_clips(series, split, clip_size)
    rows = clips.join(split.select("event_id", "label"), "event_id")
    mean = rows.groupBy(*LABEL, "channel", "dt").agg(F.avg("value").alias("m"))
    around = mean.select(*LABEL, "channel", F.col("dt").alias("at"), F.abs("m").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(clip_size - 1))).alias("dt"))
    kernel = F.exp(-((F.col("at") - F.col("dt")) ** 2) / (2 * sigma * sigma))
    weight = around.groupBy(*LABEL, "channel", "dt").agg((F.sum(kernel * F.col("size")) / F.sum(kernel)).alias("w"))
    shape = mean.join(weight, [*LABEL, "channel", "dt"])
    distance = F.sum(F.col("w") * F.col("w") * (F.col("value") - F.col("m")) ** 2)
    own = rows.join(shape, [*LABEL, "channel", "dt"]).groupBy(*LABEL, "event_id").agg(distance.alias("d"))
    size = series.groupBy(*BY).agg((F.max("t") + 1).alias("n"))
    step = F.greatest(F.lit(1).cast("bigint"), F.expr(f"n div {noise_clips}"))
    places = size.select(*BY, F.explode(F.sequence(F.lit(clip_size).cast("bigint"), F.greatest(F.col("n") - clip_size, F.lit(clip_size).cast("bigint")), step)).alias("at"))
    noise = clip_vectors(series, places.select((-F.col("at")).alias("event_id"), *BY, F.col("at").cast("double").alias("time")), clip_size)
    weights = shape.groupBy(*LABEL).agg(F.transform(F.sort_array(F.collect_list(F.struct("dt", "channel", "w"))), lambda p: p["w"]).alias("w"))

    def spread(windows: pd.DataFrame, shells: pd.DataFrame) -> pd.DataFrame:
        if not len(windows) or not len(shells):
            return pd.DataFrame({"recording_id": [], "label": [], "mean": [], "sd": []})
        d = np.array(windows["x"].tolist()) ** 2 @ (np.array(shells["w"].tolist()) ** 2).T
        sd = d.std(axis=0, ddof=1) if len(d) > 1 else np.zeros(d.shape[1])
        return shells[[*BY, "label"]].assign(mean=d.mean(axis=0), sd=sd)

    back = noise.groupBy(*BY).cogroup(weights.groupBy(*BY)).applyInPandas(spread, "recording_id string, label int, mean double, sd double")
    return own.join(back, LABEL).select("event_id", F.coalesce((F.col("d") - F.col("mean")) / F.nullif("sd", F.lit(0.0)), F.lit(0.0)).alias("outlier_score"))


def detectability_scores(series: DataFrame, firings: DataFrame, clip_size: int, shell_increment: float, min_shell_size: int, noise_clips: int = 10000, quiet: float = 2.0, seed: int = 0) -> DataFrame:
    """event_id, detectability_score: the norm of the mean clip of the event's shell without its component along
    the shape of the noise, over the slope of these norms on the magnitudes of the mean clips' peaks.

    A label's channel is its first event's. The shells go by the value of each clip on that channel at its
    centre, as do the peaks. The shape of the noise of a channel is what random windows look like around a
    low value (at most ``quiet``) of that channel: their sum, weighted by that value, scaled to norm 1.
    Without a slope the norms stay as they are."""
    f = firings.where("label > 0").select("event_id", *BY, "time", "label", "channel")
    home = f.groupBy(*LABEL).agg(F.min_by("channel", "event_id").alias("home"))
    mid = (clip_size + 1) // 2 - 1
    size = series.groupBy(*BY).agg((F.max("t") + 1).alias("n"), F.sort_array(F.collect_set("channel")).alias("channels"))
    t0 = F.col("time").cast("bigint")
    inside = (t0 >= mid) & (t0 - mid + clip_size <= F.col("n"))
    at = f.join(home, LABEL).join(size.select(*BY, "n"), BY).select("event_id", *LABEL, "home", "time", F.col("home").alias("channel"), t0.alias("t"), inside.alias("inside"))
    peaks = at.join(series, [*BY, "channel", "t"], "left").select("event_id", *LABEL, "home", "channel", "time", F.when(F.col("inside"), F.coalesce("value", F.lit(0.0))).otherwise(0.0).alias("amplitude"))
    split = Stages(series.sparkSession, "detectability").write(split_into_shells(peaks, shell_increment, min_shell_size))
    mean = full_templates(series, split, clip_size)
    drawn_at = split.select(*BY).distinct().select(*BY, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(noise_clips).cast("bigint"))).alias("event_id"))
    # a place drawn several times is one window that counts as often
    drawn = _random_places(series, drawn_at, clip_size, seed).groupBy(*BY, "time").agg(F.min("event_id").alias("event_id"), F.count("*").alias("times"))
    noise = clip_vectors(series, drawn, clip_size).join(drawn.select(*BY, "event_id", "times"), [*BY, "event_id"]).join(size.select(*BY, "channels"), BY)

    def shapes(pdf: pd.DataFrame) -> pd.DataFrame:
        x, channels = np.array(pdf["x"].tolist()), list(pdf["channels"].iloc[0])
        rows = []
        for i, channel in enumerate(channels):
            value = x[:, mid * len(channels) + i]
            v = (np.where(np.abs(value) <= quiet, value, 0.0) * pdf["times"].to_numpy()) @ x
            norm = np.sqrt((v * v).sum())
            rows.append((pdf["recording_id"].iloc[0], channel, (v / norm if norm else v).tolist()))
        return pd.DataFrame(rows, columns=["recording_id", "home", "v"])

    shape = noise.groupBy(*BY).applyInPandas(shapes, "recording_id string, home int, v array<double>")
    of = split.groupBy(*LABEL).agg(F.min("home").alias("home"))
    centre = F.max(F.when((F.col("channel") == F.col("home")) & (F.col("dt") == mid), F.col("mean")))
    flat = mean.join(of, LABEL).groupBy(*LABEL, "home").agg(F.transform(F.sort_array(F.collect_list(F.struct("dt", "channel", "mean"))), lambda s: s["mean"]).alias("m"), F.abs(centre).alias("peak"))
    rest = F.zip_with("m", "v", lambda a, b: a - F.col("dot") * b)
    score = flat.join(shape, [*BY, "home"]).withColumn("dot", _dot("m", "v")).select(*LABEL, "peak", F.sqrt(F.aggregate(rest, F.lit(0.0), lambda s, x: s + x * x)).alias("score"))
    slope = score.groupBy(*BY).agg(F.nullif(F.coalesce(F.covar_pop("peak", "score") / F.nullif(F.var_pop("peak"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("slope"))
    value = score.join(slope, BY).select(*LABEL, (F.col("score") / F.coalesce("slope", F.lit(1.0))).alias("detectability_score"))
    return split.select("event_id", *LABEL).join(value, LABEL).select("event_id", "detectability_score")


def ms_metrics(series: DataFrame, firings: DataFrame, clip_size: int) -> tuple[DataFrame, DataFrame]:
    """(cluster metrics, metrics of pairs of clusters): ``cluster_metrics`` and ``pair_overlap``."""
    return cluster_metrics(series, firings, clip_size), pair_overlap(series, firings, clip_size)


def noise_nearest(series: DataFrame, firings: DataFrame, clip_size: int, noise_level: float = 1.0, k: int = 5, n_features: int = 20, seed: int = 0, block: int = 16384) -> DataFrame:
    """recording_id, label1, label2, n: how events, with noise added, would be labelled by the majority of
    their k nearest events; label 0 stands for random windows, as many as there are events.

    All events take part. A recording is cut into blocks by hash, each pair of blocks is one task's work,
    and the nearest of an event's blocks are merged: the work grows with the square of a recording's events."""
    sample = firings.where("label > 0").select("event_id", *LABEL, "time")
    own = clip_vectors(series, sample, clip_size).join(sample.select("event_id", "label"), "event_id").withColumn("random", F.lit(False))
    none = _random_vectors(series, sample, clip_size, seed).withColumn("label", F.lit(0)).withColumn("random", F.lit(True))
    extra = _random_vectors(series, sample, clip_size, seed + 1).select(*BY, "event_id", F.col("x").alias("noise"))
    blocks = sample.groupBy(*BY).agg(F.ceil(2 * F.count("*") / block).cast("int").alias("blocks"))
    place = F.pmod(F.xxhash64("event_id", "random"), F.col("blocks")).cast("int")
    stages = Stages(series.sparkSession, "nearest")
    rows = own.unionByName(none).join(extra, [*BY, "event_id"]).join(blocks, BY)
    rows = stages.write(rows.select(*BY, "blocks", place.alias("block"), "event_id", "random", "label", "x", F.zip_with("x", "noise", lambda a, b: a + noise_level * b).alias("y")))
    axes = components(rows.select(*BY, "x").unionByName(rows.select(*BY, F.col("y").alias("x"))), n_features)
    axes = axes.join(blocks, BY).select(*BY, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "component", "direction")

    def project(pdf: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        c = np.array(to.sort_values("component")["direction"].tolist()).T
        return pdf.assign(**{v: list(np.array(pdf[v].tolist()) @ c) for v in "xy"} if len(pdf) else {})

    kinds = "recording_id string, blocks int, block int, event_id bigint, random boolean, label int, x array<double>, y array<double>"
    f = stages.write(rows.groupBy(*BY, "block").cogroup(axes.groupBy(*BY, "block")).applyInPandas(project, kinds))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    noised = f.select(*BY, "block", every.alias("other"), "event_id", "random", "label", "y")
    clean = f.select(*BY, every.alias("block"), F.col("block").alias("other"), "event_id", "random", "label", "x")

    def near(pdf: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(others):
            return pdf.iloc[:0][[*BY, "event_id", "random", "label"]].assign(distance=None, who=None, kind=None)
        same = bool(pdf["block"].iloc[0] == pdf["other"].iloc[0])
        pdf, others = (p.sort_values(["random", "event_id"], ascending=[False, True]) for p in (pdf, others))
        found = nearest(np.array(pdf["y"].tolist()), np.array(others["x"].tolist()), k, same)
        who, kind = np.where(others["random"], -1 - others["event_id"], others["event_id"]), others["label"].to_numpy()
        return pdf[[*BY, "event_id", "random", "label"]].assign(distance=[d for _, d in found], who=[who[j] for j, _ in found], kind=[kind[j] for j, _ in found])

    part = noised.groupBy(*BY, "block", "other").cogroup(clean.groupBy(*BY, "block", "other")).applyInPandas(near, "recording_id string, event_id bigint, random boolean, label int, distance array<double>, who array<bigint>, kind array<int>")
    merged = part.groupBy(*BY, "event_id", "random", "label").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("distance", "who", "kind")))), 1, k)["kind"].alias("kinds"))
    votes = F.transform(F.array_distinct("kinds"), lambda c: F.struct(F.size(F.filter("kinds", lambda x: x == c)).alias("n"), (-c).alias("name")))
    return merged.where(F.size("kinds") > 0).groupBy(*BY, F.col("label").alias("label1"), (-F.array_max(votes)["name"]).alias("label2")).agg(F.count("*").alias("n"))
