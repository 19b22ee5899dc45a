import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import packing


def plain(sizes, capacity):
    """The rule by brute force: the sum of squares of every choice."""
    level, out, n = {}, [], 0
    for s in sizes:
        best = None
        for h in [h for h, c in level.items() if c and h + s <= capacity] + [0]:
            new = dict(level)
            if h:
                new[h] -= 1
            if h + s < capacity:
                new[h + s] = new.get(h + s, 0) + 1
            key = (sum(v * v for v in new.values()), -h)
            if best is None or key < best[0]:
                best = (key, new, h)
        level = best[1]
        n += best[2] == 0
    return n, sorted((h, c) for h, c in level.items() if c)


@given(st.lists(st.integers(1, 12), max_size=60))
@settings(max_examples=80, deadline=None)
def test_rule(sizes):
    where = packing.sum_of_squares(np.array(sizes, np.int64), 12)
    fill = np.bincount(where, weights=sizes) if sizes else np.zeros(0)
    assert (fill <= 12).all()
    names, n = np.unique(fill[fill < 12], return_counts=True)
    assert (len(fill), [(int(a), int(b)) for a, b in zip(names, n)]) == plain(sizes, 12)


@pytest.mark.parametrize("shard", [40, 100_000])
def test_containers(spark, shard):
    rng = np.random.default_rng(0)
    sizes = [0, None, -3, 5000, 4096, 2048, 2049, *rng.integers(1, 1500, 400).tolist()]
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in enumerate(sizes)], "doc_id bigint, n_tokens int, shard string, piece int")
    got = packing.pack_documents(df) if shard > 1000 else packing.pack(df, "doc_id", "n_tokens", shard=shard)
    rows = got.withColumnRenamed("n", "n_tokens").collect()
    fill, pieces = {}, {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
    assert max(fill.values()) <= 2048 and all(r.container_fill == fill[r.container_id] for r in rows)
    for i, s in enumerate(sizes):
        s = max(0, s or 0)
        assert sum(n for _, n in pieces[i]) == s and [p for p, _ in sorted(pieces[i])] == list(range(len(pieces[i])))
        assert len(pieces[i]) == max(1, -(-s // 2048))
    assert len(fill) <= 1.08 * sum(max(0, s or 0) for s in sizes) / 2048 + 2


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack_documents(none).count() == 0
    zero = spark.createDataFrame([(1, 0), (1, 0), (2, None)], "doc_id bigint, n_tokens bigint")
    assert {r.container_id for r in packing.pack_documents(zero).collect()} == {"0-0"}
    stubborn = spark.createDataFrame([(i, 1500) for i in range(100)], "doc_id bigint, n_tokens bigint")
    assert packing.pack(stubborn, "doc_id", "n_tokens", shard=20).select("container_id").distinct().count() == 100
