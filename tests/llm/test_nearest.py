import random

from eventloom.llm import nearest as nn


def frames(spark, a, b):
    schema = "event_id bigint, recording_id string, channel int, time double, t double, rid string"
    pad = lambda rows: [(*r, 1.0, "x") for r in rows]
    return spark.createDataFrame(pad(a), schema), spark.createDataFrame(pad(b), schema)


def brute(a, b, tolerance):
    out = []
    for i, r, c, t in set(a):
        near = [(abs(t - u), u, j) for j, s, d, u in set(b) if r is not None and c is not None and t is not None and u is not None and (r, c) == (s, d) and abs(t - u) <= tolerance]
        if near:
            out.append((i, min(near)[2]))
    return sorted(out, key=repr)


def test_against_brute_force(spark, rows):
    rng = random.Random(3)
    draw = lambda n, base: [(base + i, rng.choice(["p", "q", None]) if i % 9 == 0 else "p", rng.choice([1, 2]), None if i % 17 == 0 else round(rng.uniform(-300, 900), 3)) for i in range(n)]
    a, b = draw(150, 1), draw(60, 1000)
    left, right = frames(spark, a + a[:9], b + b[:9])
    assert rows(nn.nearest_firings(left, right)) == brute(a, b, 20.0)
    for rings in (1, 2, 6):
        got = nn.nearest(left.withColumnRenamed("event_id", "l"), right.withColumnRenamed("event_id", "r"), ["recording_id", "channel"], "time", "l", "r", 7.5, rings)
        assert rows(got, "l", "r") == brute(a, b, 7.5)


def test_bursts_ties_and_edges(spark, rows):
    a = [(1, "p", 1, 100.0), (2, "p", 1, 100.0), (3, "p", 1, 120.0), (4, "p", 1, float("inf")), (5, "p", 1, 300.0)]
    b = [(20, "p", 1, 90.0), (11, "p", 1, 110.0), (12, "p", 1, 140.0), (14, "p", 1, 90.0), (15, "p", 1, float("nan")), (16, "p", 1, 320.0), (17, "p", 1, 279.999)] + [(100 + i, "p", 1, 5000.0) for i in range(200)]
    left, right = frames(spark, a, b)
    assert rows(nn.nearest_firings(left, right)) == [(1, 14), (2, 14), (3, 11), (5, 16)]
    assert nn.nearest_firings(left.limit(0), right).count() == 0 == nn.nearest_firings(left, right.limit(0)).count()


def test_bursts_on_both_sides(spark, rows):
    a = [(i, "p", 1, 50 + i * 1e-4) for i in range(1, 400)] + [(i, "p", 1, 61 + i * 1e-4) for i in range(500, 700)]
    b = [(1000 + i, "p", 1, 50.00005 + i * 1e-4) for i in range(300)] + [(2000, "p", 1, 70.5)]
    left, right = frames(spark, a, b)
    assert rows(nn.nearest_firings(left, right)) == brute(a, b, 20.0)


def test_ids_of_other_types_and_no_tolerance(spark, rows):
    left = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 6.0)], "l string, k int, time double")
    right = spark.createDataFrame([(7, 1, 5.0), (8, 1, 6.5)], "r bigint, k int, time double")
    assert rows(nn.nearest(left, right, ["k"], "time", "l", "r", 0.0), "l", "r") == [("a", 7)]
    assert rows(nn.nearest(left, right, ["k"], "time", "l", "r", 0.5), "l", "r") == [("a", 7), ("b", 8)]
