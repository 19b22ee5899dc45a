import numpy as np
import pytest

from eventloom.llm import clusters as cl


def clips(seed=0, units=5, sizes=(40, 25, 12, 6, 2), alone=6):
    rng = np.random.default_rng(seed)
    rows, truth, event = [], {}, 10
    for u in range(units):
        wave = rng.standard_normal(80)
        for _ in range(sizes[u]):
            x = (wave + 0.2 * rng.standard_normal(80)) * rng.uniform(0.5, 30) + rng.uniform(-50, 50)
            x = [None if rng.random() < 0.02 else float(v) for v in x]
            rows.append((event, x, None, u))
            truth[event] = u
            event += int(rng.integers(1, 40_000))
    for _ in range(alone):
        rows.append((event, [float(v) for v in rng.standard_normal(80)], [1.0], 0))
        event += 1
    bad = [(event, None, None, 0), (event + 1, [], None, 0), (event + 2, [0.0] * 80, None, 0), (event + 3, [None] * 80, None, 0), (event + 4, [1.0] * 79, None, 0), (event + 6, [1.0, 2.0], None, 0), (event + 5, [5.0] * 80, None, 0)]
    return rows + bad + rows[:7], truth


SCHEMA = "event_id bigint, clips array<double>, features2 array<double>, pivot int"


@pytest.mark.parametrize("first,most", [(256, 4096), (3, 8)])
def test_clusters(spark, rows, monkeypatch, first, most):
    monkeypatch.setattr(cl, "FIRST", first)
    monkeypatch.setattr(cl, "MOST", most)
    data, truth = clips()
    got = rows(cl.next_members(spark.createDataFrame(data, SCHEMA)))
    expected = []
    for u in set(truth.values()):
        members = sorted(e for e, v in truth.items() if v == u)
        expected += zip(members, members[1:])
    assert got == sorted(expected, key=repr)


def test_masked_correlation_against_numpy():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((2, 20, 80))
    x[rng.random(x.shape) < 0.1] = np.nan
    y[::2][rng.random((10, 80)) < 0.1] = np.nan
    got = cl.correlations(cl.Waves(x), cl.Waves(y))
    for i in range(20):
        for j in range(20):
            both = np.isfinite(x[i]) & np.isfinite(y[j])
            assert got[i, j] == pytest.approx(np.corrcoef(x[i, both], y[j, both])[0, 1], abs=1e-9)


def test_description(spark):
    data, truth = clips(2)
    df = spark.createDataFrame(data, SCHEMA)
    wave = next(x for e, x, *_ in data if truth.get(e) == 0 and None not in x)
    templates = spark.createDataFrame([(7, [3 * v + 1 for v in wave]), (8, [0.0] * 80), (9, None)], "result_id bigint, template0 array<double>")
    got = cl.describe(df, templates).orderBy("n_members").collect()
    assert [r.n_members for r in got] == [2, 6, 12, 25, 40]
    assert all(r.typical[0] == r.cluster_id and len(r.typical) == min(3, r.n_members) for r in got)
    assert [r.template_id for r in got] == [None] * 4 + [7] and got[-1].template_similarity > 0.9
    assert cl.describe(df.limit(0), templates).count() == 0


def test_next_in_group_across_spans(spark, rows):
    df = spark.createDataFrame([(1, i) for i in (3, 70_000, 70_001, 500_000)] + [(2, 5)], "g int, item bigint")
    assert rows(cl.next_in_group(df, "g", "item").where("next is not null")) == [(1, 3, 70_000), (1, 70_000, 70_001), (1, 70_001, 500_000)]


def test_short_clips_and_other_lengths(spark, rows):
    rng = np.random.default_rng(4)
    wave = rng.standard_normal(120)
    data = [(i, [float(v) for v in wave[: (120, 100, 61)[i % 3]] * (1 + i) + 3 + 0.01 * i], None, 0) for i in range(1, 10)]
    data += [(50, [float(v) for v in wave[:30]], None, 0)]  # shares a quarter of the samples
    got = rows(cl.next_members(spark.createDataFrame(data, SCHEMA)))
    assert got == [(i, i + 1) for i in range(1, 9)]


def test_pivots_are_the_local_minima_of_the_hash_order(spark, tmp_path):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    waves = rng.standard_normal((6, 20))
    x = waves[rng.integers(0, 6, 200)] + 0.35 * rng.standard_normal((200, 20))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "event_id bigint, clips array<double>")
    stages = cl.Stages(spark, "test")
    table = stages.write(cl.waveforms(df, "event_id", "clips", 20))
    order = [r[0] for r in table.orderBy(F.xxhash64("event_id")).select("event_id").collect()]
    alike = np.corrcoef(x) > 0.8
    left, expected = list(order), []
    while left:
        minima = [i for k, i in enumerate(left) if not alike[i, left[:k]].any()]
        expected += minima
        left = [i for i in left if not alike[i, minima].any()]
    found = cl.pivot_rounds(table, stages, 0.8, 20)
    assert sorted(r[0] for r in found.select("pivot").distinct().collect()) == sorted(expected)
