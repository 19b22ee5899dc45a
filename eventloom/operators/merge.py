"""Merging, dropping and renumbering of clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.kernels.isosplit import isocut
from eventloom.operators.aggregates import LABEL, channel_peaks, compute_templates
from eventloom.operators.events import relabel_dense, remove_redundant
from eventloom.operators.joins import coincidence_fraction, cross_correlogram, extract_clips
from eventloom.operators.metrics import discriminant_values, template_similarity
from eventloom.operators.series import BY
from eventloom.runtime import Stages


def merge_map(pairs: DataFrame) -> DataFrame:
    """recording_id, label, representative: the smallest label that pairs (label1, label2) link each label
    with, directly or through others. Where pairs have an offset (of label1 from label2), so has the result
    (of the label from its representative): offsets add up along the links and are negated against them.

    Labels of a recording are few next to its events. Each round joins a label's representative with its
    representative's, so paths halve; rounds are written, and end when nothing changes."""
    stages = Stages(pairs.sparkSession, "merge")
    offset = F.col("offset").cast("double") if "offset" in pairs.columns else F.lit(0.0)
    ahead = stages.write(pairs.where("label1 <> label2").groupBy(*BY, "label1", "label2").agg(F.min(offset).alias("offset")))
    back = ahead.select(*BY, F.col("label2").alias("label1"), F.col("label1").alias("label2"), (-F.col("offset")).alias("offset"))
    edges = stages.write(ahead.unionByName(back.join(ahead, [*BY, "label1", "label2"], "left_anti")))
    at = lambda r, o: F.struct(F.col(r).alias("r"), o.alias("o"))
    rep = stages.write(edges.groupBy(*BY, F.col("label1").alias("label")).agg(F.least(F.min(at("label2", F.col("offset"))), F.struct(F.col("label1").alias("r"), F.lit(0.0).alias("o"))).alias("p")).select(*LABEL, F.col("p.r").alias("representative"), F.col("p.o").alias("offset")))
    while True:
        near = edges.join(rep.select(*BY, F.col("label").alias("label2"), F.col("representative").alias("r"), F.col("offset").alias("more")), [*BY, "label2"]).groupBy(*BY, F.col("label1").alias("label")).agg(F.min(at("r", F.col("offset") + F.col("more"))).alias("near"))
        jump = rep.select(*BY, F.col("label").alias("representative"), F.col("representative").alias("far"), F.col("offset").alias("more"))
        step = rep.join(near, LABEL, "left").join(jump, [*BY, "representative"], "left")
        next_ = F.least("near", F.when(F.col("far").isNotNull(), at("far", F.col("offset") + F.col("more"))))
        # a label that keeps its representative keeps its offset, so that rounds end
        step = stages.write(step.select(*LABEL, "representative", F.when(next_["r"] < F.col("representative"), next_).otherwise(at("representative", F.col("offset"))).alias("next")))
        if step.where("next.r <> representative").isEmpty():
            return step.select(*LABEL, "representative", *([F.col("next.o").alias("offset")] if "offset" in pairs.columns else []))
        rep = step.select(*LABEL, F.col("next.r").alias("representative"), F.col("next.o").alias("offset"))


def tagged_merges(pairs: DataFrame, tag: str = "merged") -> DataFrame:
    """The merge map of the pairs of labels (label1, label2, tags) that carry the tag."""
    return merge_map(pairs.where(F.array_contains("tags", tag)).select(*BY, "label1", "label2"))


def unmerge(merges: DataFrame, labels: DataFrame) -> DataFrame:
    """A merge map without some labels (recording_id, label): these stand alone again, and the others of their
    group keep together, under the smallest label that is left."""
    left = merges.join(labels.select(*LABEL).distinct(), LABEL, "left_anti")
    least = left.groupBy(*BY, "representative").agg(F.min("label").alias("least"), F.count("*").alias("size"))
    out = left.join(least, [*BY, "representative"]).where("size > 1")
    return out.select(*LABEL, F.col("least").alias("representative"))


def apply_merges(firings: DataFrame, merges: DataFrame, dense: bool = True) -> DataFrame:
    out = firings.join(merges, LABEL, "left").withColumn("label", F.coalesce("representative", "label")).drop("representative")
    return relabel_dense(out) if dense else out


def merge_labels(series: DataFrame, firings: DataFrame, merge_threshold: float, clip_size: int) -> DataFrame:
    """Labels whose templates are more similar than the threshold become one, with all that chain to them."""
    alike = template_similarity(compute_templates(series, firings, clip_size)).where(F.col("similarity") > merge_threshold)
    return apply_merges(firings, merge_map(alike))


def remove_noise_clusters(series: DataFrame, firings: DataFrame, peak_threshold: float, clip_size: int = 10) -> DataFrame:
    """Events of labels whose template reaches the threshold, labels renumbered."""
    peak = compute_templates(series, firings, clip_size).groupBy(*LABEL).agg(F.max(F.abs("mean")).alias("peak"))
    return relabel_dense(firings.join(peak.where(F.col("peak") >= peak_threshold), LABEL, "left_semi"))


def shifted_similarity(templates: DataFrame, clip_size: int, max_shift: int, pairs: DataFrame) -> DataFrame:
    """recording_id, label1, label2, shift, correlation (uncentred), residual (energy left after the best
    scaling of 2 onto 1, over the energy of 1): the best shift of at most max_shift of each of the pairs of
    labels (recording_id, label1, label2, each once)."""
    a = templates.select(*BY, F.col("label").alias("label1"), "channel", "dt", F.col("mean").alias("m1"))
    b = templates.select(*BY, F.col("label").alias("label2"), "channel", F.col("dt").alias("dt2"), F.col("mean").alias("m2"))
    moved = b.withColumn("shift", F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift)))).withColumn("dt", F.col("dt2") + F.col("shift"))
    n1 = a.groupBy(*BY, "label1").agg(F.sum(F.col("m1") * F.col("m1")).alias("e1"))
    n2 = b.groupBy(*BY, "label2").agg(F.sum(F.col("m2") * F.col("m2")).alias("e2"))
    dot = a.join(pairs.select(*BY, "label1", "label2"), [*BY, "label1"]).join(moved, [*BY, "label2", "channel", "dt"]).where("label1 <> label2").groupBy(*BY, "label1", "label2", "shift").agg(F.sum(F.col("m1") * F.col("m2")).alias("dot"))
    r = F.coalesce(F.col("dot") / F.nullif(F.sqrt(F.col("e1") * F.col("e2")), F.lit(0.0)), F.lit(0.0))
    best = dot.join(n1, [*BY, "label1"]).join(n2, [*BY, "label2"]).groupBy(*BY, "label1", "label2").agg(F.max(F.struct(r.alias("correlation"), (-F.abs("shift")).alias("closeness"), "shift")).alias("b"))
    return best.select(*BY, "label1", "label2", "b.shift", "b.correlation", (1 - F.col("b.correlation") ** 2).alias("residual"))


def merge_across_channels(series: DataFrame, firings: DataFrame, clip_size: int, min_peak_ratio: float = 0.7, max_dt: int = 10, min_coinc_frac: float = 0.1, min_coinc_num: int = 10, max_corr_stddev: float = 5.0, min_template_corr_coef: float = 0.5) -> DataFrame:
    """Labels of one source seen on several channels become one. A pair merges if the peaks of the weaker
    reach the ratio, the templates correlate at some shift, and enough of its events coincide at offsets
    that vary little; a merged label's times shift by the usual offset,
    summed along the labels that link it, and events that then lie within 5
    samples of the label's previous one are dropped."""
    stages = Stages(series.sparkSession, "across")
    t = stages.write(compute_templates(series, firings, clip_size))
    peak = t.groupBy(*LABEL).agg(F.max(F.abs("mean")).alias("peak"))
    p1, p2 = (peak.withColumnsRenamed({"label": f"label{i}", "peak": f"peak{i}"}) for i in (1, 2))
    n = firings.groupBy(*BY, F.col("label").alias("label1")).agg(F.count("*").alias("n1"))
    lags = cross_correlogram(firings, max_dt).where("label1 <> label2").groupBy(*BY, "label1", "label2").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.col("dt")).alias("s"), F.sum(F.col("n") * F.col("dt") * F.col("dt")).alias("ss"))
    mean = F.col("s") / F.col("c")
    fine = (F.col("c") >= min_coinc_num) & (F.col("c") >= min_coinc_frac * F.col("n1")) & (F.sqrt(F.greatest(F.col("ss") / F.col("c") - mean * mean, F.lit(0.0))) <= max_corr_stddev)
    together = lags.join(n, [*BY, "label1"]).where(fine).withColumn("offset", mean).join(p1, [*BY, "label1"]).join(p2, [*BY, "label2"])
    # templates are compared only where events coincide
    together = stages.write(together.where(F.least("peak1", "peak2") >= min_peak_ratio * F.greatest("peak1", "peak2")).select(*BY, "label1", "label2", "offset"))
    alike = shifted_similarity(t, clip_size, max_dt, together).where(F.col("correlation") >= min_template_corr_coef)
    linked = together.join(alike.select(*BY, "label1", "label2"), [*BY, "label1", "label2"], "left_semi")
    moved = merge_map(linked).withColumn("offset", F.round("offset"))
    out = firings.join(moved, LABEL, "left").withColumn("time", F.col("time") - F.coalesce("offset", F.lit(0.0))).withColumn("label", F.coalesce("representative", "label")).drop("representative", "offset")
    return relabel_dense(remove_redundant(out))


def merge_across_channels_v2(series: DataFrame, firings: DataFrame, clip_size: int, min_coinc: float = 0.5, min_peak_share: float = 0.7) -> DataFrame:
    """Drops labels whose events mostly coincide with those of a kept, stronger label that peaks on another
    channel with a like share on both channels. Labels are decided in order of descending peak; the
    decisions of a recording, a handful of numbers per pair of its labels, are one group."""
    t = compute_templates(series, firings, clip_size)
    peaks = channel_peaks(t).withColumn("size", F.abs("peak"))
    top = peaks.groupBy(*LABEL).agg(F.max("size").alias("top"), F.max_by("channel", F.struct("size", -F.col("channel"))).alias("home"))
    on = lambda i, j: peaks.select(*BY, F.col("label").alias(f"label{i}"), F.col("channel").alias(f"home{j}"), F.col("size").alias(f"s{i}{j}"))
    t1, t2 = (top.withColumnsRenamed({"label": f"label{i}", "top": f"top{i}", "home": f"home{i}"}) for i in (1, 2))
    pairs = coincidence_fraction(firings).join(t1, [*BY, "label1"]).join(t2, [*BY, "label2"]).where("home1 <> home2")
    pairs = pairs.join(on(1, 2), [*BY, "label1", "home2"]).join(on(2, 1), [*BY, "label2", "home1"])
    candidate = (F.least("s21", "top1") >= min_peak_share * F.greatest("s21", "top1")) & (F.least("s12", "top2") >= min_peak_share * F.greatest("s12", "top2"))
    pairs = pairs.where(candidate & (F.col("fraction") >= min_coinc)).select(*BY, "label1", "label2")
    known = pairs.groupBy(*BY, F.col("label1").alias("label")).agg(F.collect_set("label2").alias("rivals"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "label"], ascending=[False, True])
        kept: set[int] = set()
        for label, rivals in zip(pdf["label"], pdf["rivals"]):
            if rivals is None or not kept.intersection(int(r) for r in rivals):
                kept.add(int(label))
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "label": sorted(kept)})

    keep = top.join(known, LABEL, "left").select(*LABEL, "top", "rivals").groupBy(*BY).applyInPandas(decide, "recording_id string, label int")
    return relabel_dense(firings.join(keep, LABEL, "left_semi"))


def merge_stage(series: DataFrame, firings: DataFrame, clip_size: int, min_peak_ratio: float = 0.7, min_template_corr_coef: float = 0.9, threshold: float = 1.5) -> DataFrame:
    """Labels of like templates become one where their clips, projected on the line between them, have a
    single mode; events that then lie within 5 samples of the label's previous one are dropped."""
    t = compute_templates(series, firings, clip_size)
    peak = t.groupBy(*LABEL).agg(F.max(F.abs("mean")).alias("peak"))
    p1, p2 = (peak.withColumnsRenamed({"label": f"label{i}", "peak": f"peak{i}"}) for i in (1, 2))
    near = template_similarity(t, 0.0).where(F.col("similarity") >= min_template_corr_coef).join(p1, [*BY, "label1"]).join(p2, [*BY, "label2"])
    pairs = near.where(F.least("peak1", "peak2") >= min_peak_ratio * F.greatest("peak1", "peak2")).select(*BY, F.col("label1").alias("k1"), F.col("label2").alias("k2"))
    used = firings.join(pairs.select(*BY, F.explode(F.array("k1", "k2")).alias("label")).distinct(), LABEL, "left_semi")
    values = discriminant_values(extract_clips(series, used, clip_size), used, pairs)

    def modes(pdf: pd.DataFrame) -> pd.DataFrame:
        one = isocut(pdf["value"].to_numpy(), threshold) is None
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[:1], "label1": pdf["k1"].iloc[:1], "label2": pdf["k2"].iloc[:1]}).iloc[: int(one)]

    linked = values.groupBy(*BY, "k1", "k2").applyInPandas(modes, "recording_id string, label1 int, label2 int")
    return relabel_dense(remove_redundant(apply_merges(firings, merge_map(linked), dense=False)))


def remove_duplicate_clusters(series: DataFrame, firings: DataFrame, clip_size: int, max_residual: float = 0.5, max_shift: int = 10) -> DataFrame:
    """Of two labels that peak on different channels and explain most of each other at some shift, the one
    with the weaker template is dropped; labels renumbered."""
    t = Stages(series.sparkSession, "duplicates").write(compute_templates(series, firings, clip_size))
    top = channel_peaks(t).groupBy(*LABEL).agg(F.max_by("channel", F.struct(F.abs("peak"), -F.col("channel"))).alias("home"), F.sum(F.col("peak") * F.col("peak")).alias("power"))
    t1, t2 = (top.withColumnsRenamed({"label": f"label{i}", "home": f"home{i}", "power": f"power{i}"}) for i in (1, 2))
    weaker = F.struct(F.col("power1"), -F.col("label1")) < F.struct(F.col("power2"), -F.col("label2"))
    pairs = t1.join(t2, BY).where("home1 <> home2").where(weaker)  # labels of one recording
    same = shifted_similarity(t, clip_size, max_shift, pairs).where(F.col("residual") < max_residual)
    drop = same.select(*BY, F.col("label1").alias("label")).distinct()
    return relabel_dense(firings.join(drop, LABEL, "left_anti"))
