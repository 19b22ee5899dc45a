"""Scores, comparisons and merges restated in numpy on one small recording."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import make_firings, make_series

from eventloom import workflow
from eventloom.kernels.features import principal_components
from eventloom.operators import aggregates, features, joins, merge, metrics, series

T = 10
MID = (T + 1) // 2 - 1


@pytest.fixture(scope="module")
def recording(spark):
    """Three units of 40 events: 1 and 2 alike on channel 1, 3 on channel 2."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((2, 6000))
    rows = []
    shape = np.hanning(7)
    for i in range(120):
        t, k = 30 + 48 * i, i % 3 + 1
        x[(0, 0, 1)[k - 1], t - 3 : t + 4] += (9, 11, 12)[k - 1] * shape * (1 + 0.05 * rng.standard_normal())
        rows.append(((1, 1, 2)[k - 1], t, k))
    s, f = make_series(spark, x).cache(), make_firings(spark, rows).cache()
    clips = np.array([x[:, t - MID : t - MID + T] for _, t, _ in rows])
    labels = np.array([k for *_, k in rows])
    return s, f, x, rows, clips, labels


def flat(clips):
    return clips.transpose(0, 2, 1).reshape(len(clips), -1)


def random_clips(spark, s, f, x, seed):
    at = {r.event_id: int(r.time) for r in metrics._random_places(s, f.select("event_id", "recording_id", "label"), T, seed).collect()}
    return np.array([x[:, at[i + 1] - MID : at[i + 1] - MID + T] for i in range(len(at))])


def overlap(x, kind, k=6):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return (kind[near] != kind[:, None]).mean()


def test_noise_overlap(spark, recording):
    s, f, x, rows, clips, labels = recording
    noise = random_clips(spark, s, f, x, 0)
    for r in metrics.noise_overlap(s, f, T).collect():
        own = labels == r.label
        both = np.vstack((flat(noise[own]), flat(clips[own])))
        kind = np.repeat([0, 1], own.sum())
        assert r.noise_overlap == pytest.approx(overlap(principal_components(both, 10)[1], kind), abs=1e-9)


def test_pair_overlap(spark, recording):
    s, f, x, rows, clips, labels = recording
    got = {(r.label1, r.label2): r.overlap for r in metrics.pair_overlap(s, f, T, nearest=2, least=20).collect()}
    for a in (1, 2, 3):
        for b in (1, 2, 3):
            if a != b:
                both = np.vstack((flat(clips[labels == a]), flat(clips[labels == b])))
                expected = overlap(principal_components(both, 10)[1], np.repeat([a, b], 40))
                assert got.get((a, b), 0.0) == pytest.approx(expected if expected >= 0.01 else 0.0, abs=1e-9)
    assert metrics.pair_overlap(s, f, T, least=41).count() == 0


def test_cluster_scores_and_pairs(spark, recording, rows):
    s, f, x, events, clips, labels = recording
    noise = random_clips(spark, s, f, x, 0)
    for r in metrics.cluster_scores(s, f, T, 9.0, 0.5).collect():
        own = labels == r.label
        mean = clips[own].mean(axis=0)
        c, t = np.unravel_index(np.abs(mean).argmax(), mean.shape)
        value = (clips[own] + 0.5 * noise[own])[:, c, t] * np.sign(mean[c, t])
        assert r.score == pytest.approx((value < 9.0).mean())
    score = {(r.k1, r.k2): r.score for r in metrics.cluster_pair_scores(s, f, T, noise_level=1.0).collect()}
    assert set(score) == {(1, 2), (1, 3), (2, 3)} and score[1, 2] > score[1, 3] == pytest.approx(0, abs=0.05)
    assert set(metrics.cluster_pair_scores(s, f, T, most_comparisons=1).select("k1", "k2").toPandas().itertuples(index=False, name=None)) == {(1, 2), (2, 3)}
    guide = metrics.histogram_guide2(s, f, T).toPandas()
    assert set(zip(*guide[guide.position == 1][["k1", "k2"]].to_numpy().T)) == {(1, 2)} and len(guide) == 3 * 80
    one = guide[(guide.k1 == 1) & (guide.k2 == 3)]
    assert (one[one.k == 1].value < 0).all() and (one[one.k == 3].value > 0).all()


def test_discriminants(spark, recording):
    s, f, x, events, clips, labels = recording
    pairs = spark.createDataFrame([("r", 1, 3)], "recording_id string, k1 int, k2 int")
    v = metrics.discriminant_values(joins.extract_clips(s, f, T), f, pairs)
    m1, m3 = clips[labels == 1].mean(axis=0), clips[labels == 3].mean(axis=0)
    d = m3 - m1
    got = {r.event_id: r.value for r in v.collect()}
    expected = {i + 1: ((clips[i] - (m1 + m3) / 2) * d).sum() / (d * d).sum() for i in np.flatnonzero(labels != 2)}
    assert got.keys() == expected.keys() and np.allclose([got[i] for i in got], [expected[i] for i in got])
    a, b = (np.array([expected[i + 1] for i in np.flatnonzero(labels == k)]) for k in (1, 3))
    score = metrics.separation(v).first().score
    assert score == pytest.approx((b.mean() - a.mean()) / np.concatenate((a - a.mean(), b - b.mean())).std(ddof=1))
    guide = metrics.histogram_guide(s, f, 1, T).collect()
    assert [(r.k1, r.k2) for r in guide] == [(1, 2)]
    svm = metrics.svm_values(joins.extract_clips(s, f, T), f, pairs).toPandas()
    assert (svm[svm.k == 1].value < 0).all() and (svm[svm.k == 3].value > 0).all()


def test_detectability(spark, recording):
    s, f, x, events, clips, labels = recording
    sample = spark.createDataFrame([("r", i) for i in range(1, 501)], "recording_id string, event_id bigint")
    at = [int(r.time) for r in metrics._random_places(s, sample, T, 3).collect()]
    windows = np.array([x[:, t - MID : t - MID + T] for t in at])
    norm, peak = [], []
    for k in (1, 2, 3):
        home = (0, 0, 1)[k - 1]
        value = windows[:, home, MID]
        shape = (np.where(np.abs(value) <= 2, value, 0)[:, None, None] * windows).sum(axis=0)
        shape /= np.sqrt((shape**2).sum())
        mean = clips[labels == k].mean(axis=0)
        norm.append(np.sqrt(((mean - (mean * shape).sum() * shape) ** 2).sum()))
        peak.append(abs(mean[home, MID]))
    slope = np.cov(peak, norm)[0, 1] / np.var(peak, ddof=1)
    got = {r.event_id: r.detectability_score for r in metrics.detectability_scores(s, f, T, 0.0, 1, noise_clips=500, seed=3).collect()}
    assert np.allclose([got[i + 1] for i in range(120)], [norm[k - 1] / slope for k in labels])


def test_merges(spark, recording):
    s, f, x, events, clips, labels = recording
    count = lambda df: {r.label: r.n for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert count(merge.merge_labels(s, f, 0.9, T)) == {1: 80, 2: 40}
    assert count(merge.merge_labels(s, f, 0.999999, T)) == {1: 40, 2: 40, 3: 40}
    alike = make_firings(spark, [(c, t, 3 if k == 3 else 1 + i % 2) for i, (c, t, k) in enumerate(events)])
    assert count(merge.merge_stage(s, alike, T)) == {1: 80, 2: 40}  # one mode where labels were split at random
    assert count(merge.merge_stage(s, f, T, min_template_corr_coef=1.1)) == {1: 40, 2: 40, 3: 40}


def test_one_source_on_two_channels(spark):
    rng = np.random.default_rng(12)
    x = 0.1 * rng.standard_normal((2, 3000))
    at = 40 + 60 * np.arange(45)
    for t in at:
        x[0, t - 3 : t + 4] += 10 * np.hanning(7)
        x[1, t - 3 : t + 4] += 9 * np.hanning(7)
    s = make_series(spark, x)
    twice = make_firings(spark, [(1, t, 1) for t in at] + [(2, t + 1, 2) for t in at])
    got = merge.merge_across_channels_v2(s, twice, 20)
    assert {r.channel for r in got.collect()} in ({1}, {1, 2}) and got.select("label").distinct().count() <= 2
    y = 0.1 * rng.standard_normal((2, 3000))
    for i, t in enumerate(at):
        big, small = (0, 1) if i % 2 == 0 else (1, 0)
        y[big, t - 3 : t + 4] += 10 * np.hanning(7)
        y[small, t - 3 : t + 4] += 8 * np.hanning(7)
    f = make_firings(spark, [(1 + i % 2, t, 1 + i % 2) for i, t in enumerate(at)])
    kept = merge.remove_duplicate_clusters(make_series(spark, y), f, 20)
    assert {r.label for r in kept.collect()} == {1} and kept.count() in (22, 23)


def test_features(spark, recording):
    s, f, x, events, clips, labels = recording
    got = {r.event_id: r.features for r in features.extract_clips_features(s, f, T, 3).collect()}
    assert np.allclose([got[i + 1] for i in range(120)], principal_components(flat(clips), 3)[1], atol=1e-6)
    per = {r.event_id: r.features for r in features.channel_features(joins.extract_clips(s, f, T), 2).collect()}
    expected = np.hstack([principal_components(clips[:, c], 2)[1] for c in (0, 1)])
    assert np.allclose([per[i + 1] for i in range(120)], expected, atol=1e-6)
    geom = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 5.0)], "channel int, x double, y double")
    at = {r.event_id: (r.x, r.y) for r in features.spatial_centroid(joins.extract_clips(s, f, T), geom).collect()}
    energy = (clips**2).sum(axis=2)
    share = energy[:, 1] / energy.sum(axis=1)
    assert np.allclose([at[i + 1] for i in range(120)], np.stack((10 * share, 5 * share), axis=1))
    t = {(r.label, r.channel, r.dt): (r.mean, r.stdev) for r in aggregates.full_templates(s, f, T).collect()}
    own = clips[labels == 2]
    assert np.allclose([t[2, 1, d] for d in range(T)], np.stack((own.mean(axis=0)[0], own.std(axis=0)[0]), axis=1))


def test_quantile_codec(spark, recording):
    s, _, x, *_ = recording
    got = series.quantile_codec(s).toPandas().merge(pd.DataFrame({"channel": np.repeat([1, 2], x.shape[1]), "t": np.tile(np.arange(x.shape[1]), 2), "value": x.ravel()}), on=["channel", "t"])
    assert len(got) == x.size and got.code.between(0, 255).all()
    assert np.allclose(got.level, got.groupby("code").value.transform("mean"))
    assert got.sort_values("value").code.is_monotonic_increasing and np.bincount(got.code).max() < 1.3 * x.size / 256


def test_pairs_files_and_batches(spark, rows):
    assert joins.correlogram_pairs([1, 2, 3], "auto") == [(1, 1), (2, 2), (3, 3)]
    assert joins.correlogram_pairs([1, 2, 3], "selected_auto", [3]) == [(3, 3)]
    assert joins.correlogram_pairs([1, 2, 3], "one_vs_all", [2, 3]) == [(2, 1), (2, 2), (2, 3)]
    assert joins.correlogram_pairs([1, 2, 3], "matrix", [1, 3]) == [(1, 1), (1, 3), (3, 1), (3, 3)]
    assert joins.correlogram_pairs([], "selected_pairs", pairs=[(1, 9)]) == [(1, 9)]
    with pytest.raises(ValueError):
        joins.correlogram_pairs([1], "none")
    wanted = spark.createDataFrame([("w", 5, "a", "b")], "name string, original_size int, original_checksum string, original_checksum_1000 string")
    files = spark.createDataFrame([("x", 5, "a", "b"), ("y", 5, "a", "c"), ("z", 6, "a", "b")], "path string, original_size int, original_checksum string, original_checksum_1000 string")
    assert rows(workflow.locate(wanted, files), "name", "path") == [("w", "x")]
    assert workflow.batch(files.select("path"), wanted.select("name")).count() == 3
    old = spark.createDataFrame([(1, {"a": 1.0}), (2, {"a": 2.0, "b": 5.0}), (4, None)], "label int, metrics map<string,double>")
    new = spark.createDataFrame([(2, 9.0, None), (3, 1.0, 2.0)], "label int, a double, c double")
    got = {r.label: r.metrics for r in aggregates.upsert_metrics(old, new, ["label"]).collect()}
    assert got == {1: {"a": 1.0}, 2: {"a": 9.0, "b": 5.0}, 3: {"a": 1.0, "c": 2.0}, 4: {}}


def test_multiscale_reading(spark):
    x = np.random.default_rng(1).standard_normal((2, 100))
    s = make_series(spark, x)
    levels = series.multiscale(s)
    for factor in (1, 3, 27):
        got = {(r.channel, r.bin): (r.vmin, r.vmax) for r in series.read_multiscale(levels, s, -2, 40, factor).collect()}
        for c in (1, 2):
            for b in range(-2, 41):
                part = x[c - 1, b * factor : (b + 1) * factor] if 0 <= b < 100 // factor else np.zeros(1)
                assert got[c, b] == (part.min(), part.max())
    with pytest.raises(ValueError):
        series.read_multiscale(levels, s, 0, 5, 6)


def test_refractory_against_one_pass(spark):
    from eventloom.operators import events

    rng = np.random.default_rng(2)
    at = np.sort(np.concatenate((rng.uniform(0, 400_000, 500), rng.uniform(65_000, 66_000, 400), 131_000 + np.arange(300.0))))
    f = make_firings(spark, [(1, t, 1) for t in at])
    kept, last = [], -np.inf
    for i, t in enumerate(at):
        if t - last >= 50:
            kept.append(i + 1)
            last = t
    assert sorted(r.event_id for r in events.refractory(f, 50.0).collect()) == kept
    assert sorted(r.event_id for r in events.refractory(f, 50.0, cut=100.0).collect()) == kept


def test_segments_split_where_nothing_meets(spark):
    rng = np.random.default_rng(3)
    a, b = (np.sort(rng.integers(0, 300_000, 400)) for _ in range(2))
    rows = joins._segments(make_firings(spark, [(1, t, 1) for t in a]), make_firings(spark, [(1, t, 2) for t in b]), 10).collect()
    assert len(rows) == 800
    times = sorted((r.t, r.segment) for r in rows)
    assert all(s == z for (t, s), (u, z) in zip(times, times[1:]) if u - t <= 10) and len({s for _, s in times}) == 5


def test_clip_vectors_are_the_flattened_clips(spark):
    x = np.random.default_rng(4).standard_normal((3, 60))
    s = make_series(spark, x).where("not (channel = 2 and t between 20 and 22) and t <> 30")
    f = make_firings(spark, [(1, 21.7, 1), (1, 2, 1), (2, 55, 1), (3, 58, 1), (1, 30, 0), (2, 4, 2)])
    got = {r.event_id: r.x for r in joins.clip_vectors(s, f, T).collect()}
    expected = {r.event_id: r.x for r in features.clip_vectors(joins.extract_clips(s, f, T)).collect()}
    assert got == expected and len(got) == 6
