import numpy as np

from eventloom.operators import spikes


def frames(spark, points, bounds=(("r", -1000.0, 1000.0),)):
    readings = spark.createDataFrame(points, "recording_id string, channel int, t bigint, value double, chunk string, g string")
    return readings, spark.createDataFrame(list(bounds), "recording_id string, adc_min double, adc_max double")


def noisy(n, seed=0, drift=0.0, scale=1.0):
    rng = np.random.default_rng(seed)
    return 50 + drift * np.arange(n) + scale * rng.standard_normal(n)


def found(spark, x, t=None, **kw):
    points = [("r", 1, int(i), None if v is None else float(v), "c", None) for i, v in zip(range(len(x)) if t is None else t, x)]
    readings, recordings = frames(spark, points + points[:50], **kw)
    return sorted(r.t for r in spikes.found_readings(readings, recordings).collect())


def test_spikes_stuck_and_impossible(spark):
    x = noisy(3000)
    x[500] += 14
    x[900:903] -= 20  # a run of spikes
    x[1200] += 7  # not far enough
    x[1500:1516] = x[1500] + 0.0005 * np.arange(16)
    x[1700:1714] = x[1700]  # too short
    x = x.tolist()
    x[2000], x[2001], x[2002], x[2003] = float("nan"), float("inf"), 1000.5, None
    assert found(spark, x) == [500, 900, 901, 902, *range(1500, 1516), 2000, 2001, 2002]


def test_steps_and_drift_are_no_spikes(spark):
    x = noisy(4000, 1, drift=0.05)
    x[2000:] += 40  # a lasting step
    assert found(spark, x) == []


def test_chunk_borders(spark, monkeypatch):
    x = noisy(spikes.CHUNK + 3000, 2)
    c = spikes.CHUNK
    x[c - 1], x[c + 700] = x[c - 1] + 30, x[c + 700] - 30
    x[c - 8 : c + 9] = 50.0
    assert found(spark, x) == [*range(c - 8, c + 9), c + 700]


def test_defined_cases(spark):
    readings, recordings = frames(spark, [("r", 1, 1, None, None, None), (None, 1, 2, 5.0, None, None), ("r", None, 3, 5.0, None, None), ("r", 1, None, 5.0, None, None), ("other", 1, 4, 1e9, None, None), ("other", 1, 5, float("nan"), None, None)])
    assert [tuple(r) for r in spikes.found_readings(readings, recordings).collect()] == [("other", 1, 5)]
    assert spikes.found_readings(readings.limit(0), recordings).count() == 0
    assert spikes.found_readings(readings, recordings.limit(0)).count() == 1
    constant, recordings = frames(spark, [("r", 1, i, 3.0, None, None) for i in range(100)])
    assert spikes.found_readings(constant, recordings).count() == 0  # no spread


def test_spread_does_not_depend_on_chunks(spark):
    x = noisy(3 * spikes.CHUNK, 3, scale=2.5)
    points = [("r", 1, i, float(v), None, None) for i, v in enumerate(x)]
    readings, recordings = frames(spark, points)
    x[100] = 50 + 2.5 * 12
    flags = spikes.flag_readings(frames(spark, [("r", 1, i, float(v), None, None) for i, v in enumerate(x)])[0], recordings).collect()
    assert [r.t for r in flags] == [100] and 10.5 < flags[0].score < 13.5


def test_long_runs_are_decided_as_a_whole(spark):
    for length in (10, 30, 60, 200, 500):
        x = noisy(4000, 5)
        x[1500 : 1500 + length] += 30
        assert found(spark, x) == list(range(1500, 1500 + length))
    x = noisy(4000, 5)
    x[1500:2100] += 30  # longer than LONGEST: a new level
    assert found(spark, x) == []


def test_noisy_chunk_and_stuck_chunk(spark):
    c = spikes.CHUNK
    x = noisy(4 * c, 6)
    x[c : 2 * c] = 50 + 4 * (x[c : 2 * c] - 50)  # one chunk of four times the spread
    x[c + 500 : c + 516] = x[c + 500]
    x[3 * c : 4 * c] = x[3 * c]  # a whole chunk stuck
    got = found(spark, x)
    assert set(range(c + 500, c + 516)) <= set(got) and set(range(3 * c, 4 * c)) <= set(got)


def test_readings_that_agree_with_no_level(spark):
    x = noisy(3000, 7)
    x[1000:1700] += np.where(np.arange(700) % 2 == 0, 300, -300)
    got = found(spark, x)
    assert got and min(got) >= 1000 and max(got) < 1700


def test_blocks_against_one_reading_at_a_time():
    rng = np.random.default_rng(8)
    for case in range(20):
        n = 1500
        y = np.cumsum(rng.normal(0, 0.1, n)) + rng.standard_normal(n)
        y[rng.integers(0, n, 20)] += 40
        start = int(rng.integers(200, 800))
        y[start : start + (30, 700)[case % 2]] += 60
        t = np.cumsum(rng.choice([1, 1, 1, 1, 2, 900], n, p=[0.2, 0.2, 0.2, 0.2, 0.199, 0.001]))
        skip = rng.random(n) < 0.03
        levels, flags = spikes.forecast(t, y, skip, 1.0)
        limit = spikes.FLAG * np.sqrt(1 + spikes._PRIOR)
        level, last, i, run, restarted = None, None, 0, -1, -1
        use = np.flatnonzero(~skip).tolist()
        want, flagged = {}, {}
        while i < len(use):
            k = use[i]
            if last is None or t[k] - last > spikes.LONGEST:
                seg = [j for j in use[i:]]
                stop = next((m for m in range(1, len(seg)) if t[seg[m]] - t[seg[m - 1]] > spikes.LONGEST), len(seg))
                level, run, restarted = np.median(y[seg[: min(stop, spikes.FIRST)]]), -1, -1
            want[k], flagged[k] = level, abs(y[k] - level) > limit
            if flagged[k]:
                run = i if run < 0 else run
                if t[k] - t[use[run]] > spikes.LONGEST and run != restarted:
                    level, restarted = np.median(y[use[run : i + 1]]), run
                    i, run = run, -1
                    last = t[use[i]]
                    continue
            else:
                level, run = level + spikes.GAIN * (y[k] - level), -1
            last, i = t[k], i + 1
        assert np.allclose(levels[use], [want[k] for k in use]) and flags[use].tolist() == [flagged[k] for k in use]
