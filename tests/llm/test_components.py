import random

import numpy as np
import pytest

from eventloom.llm import components as cc


def brute(edges, alone=()):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    for x in alone:
        find(x)
    return sorted((find(x), x) for x in list(parent))


def frame(spark, rows):
    return spark.createDataFrame(rows, "a int, b int, cell string, v string")


@pytest.mark.parametrize("per_cell", [5, 40, 100_000])
def test_random_graphs_and_chains(spark, rows, per_cell):
    rng = random.Random(per_cell)
    edges = [(rng.randint(-50, 400), rng.randint(-50, 400)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(80)]
    got = rows(cc.components(frame(spark, [(*e, "x", None) for e in edges + edges[:20]]), "a", "b", per_cell))
    assert got == sorted(brute(edges), key=repr)


def test_defined_cases(spark, rows):
    df = frame(spark, [(1, None, "", None), (None, 2, "", None), (None, None, "", None), (3, 3, "", None), (5, 4, "", None)])
    assert rows(cc.components(df, "a", "b")) == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 5)]
    assert cc.components(df.limit(0), "a", "b").count() == 0


def test_labels(spark, rows):
    pairs = spark.createDataFrame([(1, 0, 7, None), (2, None, 8, 0.1), (3, 9, 9, 0.1), (4, 2, 3, None), (4, 2, 3, None)], "pair_id bigint, m_k1 int, m_k2 int, overlap double")
    sets = spark.createDataFrame([(1, [3, 11, None, 0, 11]), (2, None), (3, []), (4, [12]), (5, [0, None])], "set_id bigint, members array<int>")
    assert rows(cc.label_groups(pairs, sets)) == sorted([(7, 7), (8, 8), (9, 9), (2, 2), (2, 3), (2, 11), (12, 12)], key=repr)


def test_local_union_find():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(2, 60))
        a, b = rng.integers(0, n, (2, int(rng.integers(1, 60))))
        rank = rng.permutation(n).astype(np.uint64)
        root = cc.local_roots(a, b, rank)
        groups = {}
        for g, x in brute(zip(a.tolist(), b.tolist()), range(n)):
            groups.setdefault(g, []).append(x)
        for members in groups.values():
            assert {int(root[m]) for m in members} == {min(members, key=lambda m: rank[m])}
