"""Series, event and join operators on fixtures small enough to check by hand or by numpy."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import aggregates, detection, events, features, joins, merge, metrics, series


def make_series(spark, x, rec="r"):
    return spark.createDataFrame([(rec, m + 1, t, float(v)) for m, row in enumerate(x) for t, v in enumerate(row)], "recording_id string, channel int, t bigint, value double")


def make_firings(spark, rows, rec="r"):
    return spark.createDataFrame([(i + 1, rec, c, float(t), k, 1.0, 0.0, 0.0) for i, (c, t, k) in enumerate(rows)], "event_id bigint, recording_id string, channel int, time double, label int, amplitude double, outlier_score double, detectability_score double")


def dense(df):
    rows = df.collect()
    out = np.zeros((max(r.channel for r in rows), max(r.t for r in rows) + 1))
    for r in rows:
        out[r.channel - 1, r.t] = r.value
    return out


@pytest.fixture(scope="module")
def x():
    n, m = np.meshgrid(np.arange(90), np.arange(3))
    return np.sin(np.sin(m) + np.sin(n) + np.sin(m + n))


def test_normalize_and_whiten(spark, x):
    s = make_series(spark, x)
    assert np.allclose(dense(series.normalize_channels(s)), x / np.sqrt((x**2).sum(axis=1, keepdims=True) / 89))
    y = dense(series.whiten(s))
    assert np.allclose(y @ y.T / 89, np.eye(3), atol=1e-8)
    zero = make_series(spark, np.zeros((1, 5)))
    assert (dense(series.normalize_channels(zero)) == 0).all() and (dense(series.quantize(zero, "int16")) == 0).all()


def test_bandpass_is_one_transform_where_one_chunk_holds_all(spark):
    x = 1 + np.sin(np.arange(400)[None] + np.sin(np.arange(2))[:, None])
    got = dense(series.bandpass_filter(make_series(spark, x), 10_000, 300, 3000, chunk=1000))
    gain = series.band(400, 10_000, 300, 3000, 1000)
    assert np.allclose(got, np.fft.ifft(np.fft.fft(x) * gain).real)
    assert abs(got.mean()) < 1e-9


def test_chunks_agree_with_the_whole(spark):
    x = np.random.default_rng(0).standard_normal((1, 3000))
    s = make_series(spark, x)
    whole, parts = dense(series.exponential_filter(s, 5.0, chunk=10_000)), dense(series.exponential_filter(s, 5.0, chunk=500))
    assert np.allclose(whole, parts, atol=1e-12)
    key = lambda df: sorted((r.channel, r.time) for r in df.collect())
    assert key(detection.detect(s, 10, 5, 2.0)) == key(detection.detect(s, 10, 5, 2.0, chunk=700))
    assert key(detection.detect_local_max(s, 10, 5, 2.0)) == key(detection.detect_local_max(s, 10, 5, 2.0, chunk=600))


def test_artifacts_and_errors(spark):
    x = np.ones((2, 105))
    x[0, 45] = 100
    got = dense(series.mask_out_artifacts(make_series(spark, x), 2.0, 10))
    assert (got[0, 30:60] == 0).all() and (got[0, :30] == 1).all() and (got[0, 60:100] == 1).all() and (got[:, 100:] == 0).all() and (got[1, :100] == 1).all()
    kept = dense(series.mask_out_artifacts(make_series(spark, x), 2.0, 10, compat=True))
    assert (kept[0, :100] == x[0, :100]).all()
    with pytest.raises(ValueError):
        series.extract_raw(make_series(spark, x), 5, 2)


def test_noise_repeats_and_has_its_level(spark):
    s = make_series(spark, np.zeros((2, 4000)))
    a, b = dense(series.add_noise(s, 2.0, 1)), dense(series.add_noise(s, 2.0, 1))
    assert (a == b).all() and abs(a.std() - 2) < 0.1 and abs(a.mean()) < 0.1


def test_clips_templates_amplitudes(spark, x):
    s, f = make_series(spark, x), make_firings(spark, [(1, 30, 1), (2, 50.4, 1), (1, 2, 1), (3, 60, 2)])
    clips = {(r.event_id, r.channel, r.dt): r.value for r in joins.extract_clips(s, f, 10).collect()}
    assert len(clips) == 4 * 3 * 10 and clips[1, 2, 0] == pytest.approx(x[1, 26]) and all(clips[3, c, d] == 0 for c in (1, 2, 3) for d in range(10))
    padded = np.pad(x, ((0, 0), (10, 10)))
    mean = sum(padded[:, t + 10 - 4 : t + 10 + 6] for t in (30, 50, 2)) / 3
    t = {(r.label, r.channel, r.dt): r for r in aggregates.compute_templates(s, f, 10).collect()}
    assert all(t[1, c + 1, d].mean == pytest.approx(mean[c, d]) for c in range(3) for d in range(10)) and t[2, 1, 0].stdev == 0
    c, d = np.unravel_index(np.abs(mean).T.ravel().argmax(), (10, 3))[::-1]
    amplitude = {r.event_id: r.amplitude for r in aggregates.compute_amplitudes(s, f, 10).collect()}
    assert amplitude[1] == pytest.approx(x[c, 26 + d]) and amplitude[3] == 0


def test_confusion_against_plain_matching(spark):
    rng = np.random.default_rng(5)
    t1 = np.sort(rng.integers(0, 4000, 200))
    t2 = np.sort(t1 + rng.integers(-2, 3, 200))
    a = make_firings(spark, [(1, t, 1 + i % 3) for i, t in enumerate(t1)])
    b = make_firings(spark, [(1, t, 1 + i % 3) for i, t in enumerate(t2)])
    m = joins.match_events(a, b, 3)
    pairs = m.where("event_id1 is not null and event_id2 is not null").collect()
    assert len({r.event_id1 for r in pairs}) == len(pairs) == len({r.event_id2 for r in pairs})
    total = sum(r.n for r in joins.confusion_matrix(m).collect())
    assert total == 400 - len(pairs)
    best = {r.label1: r.label2 for r in joins.optimal_assignment(joins.confusion_matrix(m)).collect()}
    assert best == {1: 1, 2: 2, 3: 3}
    for compat in (False, True):
        merged = joins.merge_firings(a, b, 3, compat).collect()
        assert sum(r.label1 > 0 for r in merged) == 200 and sum(r.label2 > 0 for r in merged) == 200
    table = aggregates.accuracy_table(joins.confusion_matrix(m), joins.optimal_assignment(joins.confusion_matrix(m))).collect()
    assert all(r.n_true == r.n_correct + r.n_incorrect + r.n_missed for r in table)


def test_events_rules(spark, rows):
    f = make_firings(spark, [(1, t, 1) for t in (0, 3, 6, 20, 24, 40)])
    assert rows(events.remove_redundant(f, 5.0), "event_id") == [(1,), (4,), (6,)]
    assert rows(events.remove_redundant(f, 5.0, cut=4.0 + 8), "event_id") == [(1,), (4,), (6,)]
    assert rows(events.refractory(f, 5.0), "event_id") == [(1,), (3,), (4,), (6,)]
    assert rows(events.subfirings(f, [1], 2), "event_id") == [(1,), (4,)]
    assert events.firings_subset(f, []).count() == 0
    lines = spark.createDataFrame([("EPOCH one 1 11",), ("note",)], "value string")
    epochs = events.parse_epochs(lines).selectExpr("'r' as recording_id", "*")
    assert rows(events.in_epochs(f, epochs)) == [(1, "one"), (2, "one"), (3, "one")]


def test_shells(spark, rows):
    f = make_firings(spark, [(1, t, 1) for t in range(20)]).withColumn("amplitude", F.expr("double(if(event_id <= 10, event_id, -event_id))"))
    shell = {r.event_id: r.shell for r in metrics.define_shells(f, 2.0, 4).collect()}
    assert {shell[i] for i in range(1, 11)} <= {1, 2, 3} and {shell[i] for i in range(11, 21)} <= {-1, -2, -3}
    sizes = [sum(v == k for v in shell.values()) for k in set(shell.values())]
    assert min(sizes) >= 4
    assert {r.shell for r in metrics.define_shells(f, 0.0, 4).collect()} == {1, -1}


def test_sorting_and_ranks_hold_over_spans(spark):
    f = make_firings(spark, [(1, 7 * i % 101, 1) for i in range(100)]).withColumn("event_id", F.expr("event_id * 50000"))
    got = [r.event_id for r in events.sort_firings(f).orderBy("position").collect()]
    assert got == [r.event_id for r in f.orderBy("time", "event_id").collect()]
    assert sorted(r.rank0 for r in events._ranked(f, ["recording_id"]).collect()) == list(range(100))


def test_merge_map_chains(spark, rows):
    pairs = spark.createDataFrame([("r", i, i + 1) for i in range(1, 20)] + [("r", 40, 30), ("q", 2, 3)], "recording_id string, label1 int, label2 int")
    m = merge.merge_map(pairs)
    assert {(r.recording_id, r.representative) for r in m.collect()} == {("r", 1), ("r", 30), ("q", 2)} and m.count() == 24


def test_noise_nearest_takes_every_event(spark, rows):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2, 6000)) * 0.3
    at = 20 + 12 * np.arange(450)
    for i, t in enumerate(at):
        x[int(i % 3 == 0), t - 2 : t + 3] += 10
    s, f = make_series(spark, x), make_firings(spark, [(1, t, 1 + (i % 3 == 0)) for i, t in enumerate(at)])
    got = metrics.noise_nearest(s, f, 10, noise_level=0.1)
    total = {r.label1: r.n for r in got.groupBy("label1").agg(F.sum("n").alias("n")).collect()}
    assert total == {0: 450, 1: 300, 2: 150}
    assert rows(got) == rows(metrics.noise_nearest(s, f, 10, noise_level=0.1, block=200))
    right = {(r.label1, r.label2): r.n for r in got.collect()}
    assert right[1, 1] > 250 and right[2, 2] > 120


def test_scores_take_the_whole_background(spark, data, monkeypatch):
    from eventloom.plans import reference

    x = np.random.default_rng(9).standard_normal((1, 1200))
    f = make_firings(spark, [(1, t, 1) for t in range(50, 1150, 40)])
    got = {r.event_id: r.outlier_score for r in metrics.outlier_scores(make_series(spark, x), f, 10, 0.0, 1).collect()}
    clip = lambda t: x[0, t - 4 : t + 6]
    own = np.array([clip(t) for t in range(50, 1150, 40)])
    kernel = np.exp(-((np.arange(10)[:, None] - np.arange(10)) ** 2) / 72)
    w = (kernel * np.abs(own.mean(axis=0))).sum(axis=1) / kernel.sum(axis=1)
    back = np.array([((w * clip(t)) ** 2).sum() for t in range(10, 1191)])
    expected = (((w * (own - own.mean(axis=0))) ** 2).sum(axis=1) - back.mean()) / back.std(ddof=1)
    assert np.allclose([got[i + 1] for i in range(len(own))], expected)
    used = {}
    for name in ("outlier_scores", "detectability_scores"):
        whole = getattr(metrics, name)

        def spy(*args, whole=whole, name=name, **options):
            bound = inspect.signature(whole).bind(*args, **options)
            bound.apply_defaults()
            used[name] = bound.arguments["noise_clips"]
            return whole(*args, **options)

        monkeypatch.setattr(metrics, name, spy)
    for query in (reference.compute_outlier_scores, reference.compute_detectability_scores):
        assert query(spark, data).columns[0] == "event_id"
    assert used == {"outlier_scores": 5000, "detectability_scores": 10000}


def test_isosplit_sees_every_dimension(spark, tmp_path):
    from eventloom.plans import reference

    x = np.random.default_rng(10).standard_normal((800, 64)) * 0.01
    x[400:, 40] += 1
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    cluster = {r.event_id: r.cluster for r in reference.isosplit2(spark, str(tmp_path)).collect()}
    assert not {cluster[i] for i in range(400)} & {cluster[i] for i in range(400, 800)}


def test_fit_stage_by_shells(spark):
    size = np.array([4.0, 15, 15, 15] * 5)
    x = np.zeros((1, 1100))
    for i, a in enumerate(size):
        x[0, 45 + 50 * i : 56 + 50 * i] += a * np.hanning(11)
    f = make_firings(spark, [(1, 50 * (i + 1), 1) for i in range(20)])
    f = f.withColumn("amplitude", F.when(F.col("event_id") % 4 == 1, 4.0).otherwise(15.0))
    s = make_series(spark, x)
    assert detection.fit_stage(s, f, 12).count() == 15
    split = detection.fit_stage(s, f, 12, shell_increment=5.0, min_shell_size=5)
    assert split.count() == 20 and {r.label for r in split.collect()} == {1} and split.columns == f.columns


def test_merge_shifts_add_up_along_links(spark, rows):
    pairs = spark.createDataFrame([("r", 2, 1, 7.0), ("r", 2, 3, -7.0), ("r", 3, 4, -6.0)], "recording_id string, label1 int, label2 int, offset double")
    assert rows(merge.merge_map(pairs)) == [("r", 1, 1, 0.0), ("r", 2, 1, 7.0), ("r", 3, 1, 14.0), ("r", 4, 1, 20.0)]
    x = np.zeros((3, 4100))
    at = 60 + 100 * np.arange(40)
    for c in range(3):
        for t in at + 7 * c:
            x[c, t - 3 : t + 4] += 10 * np.hanning(7)
    f = make_firings(spark, [(c + 1, t + 7 * c, c + 1) for t in at for c in range(3)])
    out = merge.merge_across_channels(make_series(spark, x), f, 50)
    assert rows(out, "label", "time") == sorted(((1, float(t)) for t in at), key=repr)


def test_synthetic_recording_end_to_end(spark):
    from eventloom.sources.synthetic import synthesize

    s, truth = synthesize(spark, units=3, channels=3, samples=90_000, noise_level=0.5)
    s = s.cache()
    found = detection.detect(s, 40, 20, 8.0, sign=-1)
    out = features.branch_cluster(s, found, joins.linear_adjacency(s, 2), 40, detect_interval=20, consolidation_factor=0.9).selectExpr("xxhash64(channel, time) as event_id", "recording_id", "channel", "time - 1 as time", "label").cache()
    c = joins.confusion_matrix(joins.match_events(truth, out, 15)).collect()
    hit, total = {}, {}
    for r in c:
        if r.label1 > 0:
            total[r.label1] = total.get(r.label1, 0) + r.n
            if r.label2 > 0:
                hit[r.label1] = max(hit.get(r.label1, 0), r.n)
    assert sum(hit.values()) / sum(total.values()) > 0.6


@pytest.mark.parametrize("sign", [-1, 0, 1])
def test_clips_of_one_pass_are_those_of_the_detected_events(spark, rows, sign):
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_normal((3, 700)) * 4, 1)
    keep = rng.random(x.shape) > 0.2
    keep[:, 630:670] = False
    s = spark.createDataFrame([(rec, int(m) + 1, int(t), float(x[m, t])) for rec in ("r", "q") for m, t in zip(*np.nonzero(keep)) if rec == "r" or m > 0], "recording_id string, channel int, t bigint, value double")
    twice = s.unionByName(s.where("t % 3 = 0")).repartition(3)
    clips = detection.detected_clips(twice, 11, 4, 7.0, sign, chunk=128)
    size = series.extent(s)
    inside = clips.join(size.select("recording_id", "n"), "recording_id").where("time > 5 AND time + 4 < n").drop("n")
    found = detection.detect(s, 11, 4, 7.0, sign, chunk=128)
    assert rows(inside, "recording_id", "channel", "time") == rows(found) != []
    v = {(r.event_id.channel, r.event_id.time, r.recording_id): r.x for r in joins.clip_vectors(s, found.select("recording_id", F.struct("channel", "time").alias("event_id"), (F.col("time") - 1).alias("time")), 11).collect()}
    channels = {r.recording_id: r.channels for r in size.collect()}
    for r in inside.collect():
        y = np.zeros((11, len(channels[r.recording_id])))
        y[:, np.searchsorted(channels[r.recording_id], r.channels)] = np.reshape(r.x, (11, -1))
        assert y.ravel().tolist() == v[r.channel, r.time, r.recording_id]


def test_branch_cluster_reads_and_clusters_once(spark, data, rows):
    from eventloom.plans import reference

    out = reference.branch_cluster_v2(spark, data)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and plan.count("FlatMapGroupsInPandas") <= 1
    s = reference.load(spark, data).cache()
    found = detection.detect(s, reference.CLIP, 10, 200.0)
    assert rows(out) == rows(features.branch_cluster(s, found, joins.linear_adjacency(s, 1), reference.CLIP)) != []


@pytest.mark.parametrize("num_features2", [0, 1])
def test_branch_cluster_splits_by_the_sign_at_the_centre(spark, num_features2):
    rng = np.random.default_rng(8)
    size = spark.createDataFrame([("r", 10000, [1, 2])], "recording_id string, n bigint, channels array<int>")
    centre = np.linspace(-1, 1, 60)
    x = rng.standard_normal((60, 5, 2)) * 0.01
    x[:, 0, 0], x[:, 2, 0], x[:, 3, 0] = -9 + rng.standard_normal(60) * 0.01, centre, -0.1 * centre  # the largest sample is not the event's
    clips = spark.createDataFrame([("r", 1, 101.0 + 20 * i, [1, 2], x[i].ravel().tolist()) for i in range(60)], "recording_id string, channel int, time double, channels array<int>, x array<double>")
    alone = spark.createDataFrame([], "ch1 int, ch2 int")
    out = features.cluster_clips(clips, size, alone, 5, num_features2=num_features2)
    label = {r.time: r.label for r in out.collect()}
    assert [label[101.0 + 20 * i] for i in range(60)] == [2] * 30 + [1] * 30  # in order of the signed value
