import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.kernels import assign, features, isosplit, match, pursuit, svm


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_hungarian(n, m, seed):
    cost = np.random.default_rng(seed).integers(-9, 9, (n, m)).astype(float)
    got = assign.hungarian(cost)
    assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
    small, c = min(n, m), cost if n <= m else cost.T
    best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(max(n, m)), small))
    assert sum(cost[i, j] for i, j in got) == best


def test_greedy_pairs_nearest_offset_first():
    i, j = match.greedy_pairs(np.array([10, 12]), np.array([11, 12]), 3, None, np.array([1, 1]))
    assert sorted(zip(i, j)) == [(0, 0), (1, 1)]
    i, j = match.greedy_pairs(np.array([10]), np.array([10, 11]), 3, np.array([7]), np.array([1, 7]))
    assert list(zip(i, j)) == [(0, 1)]


def test_heaviest_pairs():
    t1, l1, t2, l2 = np.array([10, 30]), np.array([1, 1]), np.array([9, 11, 30]), np.array([1, 2, 1])
    i, j = match.heaviest_pairs(t1, l1, t2, l2, 2, {(1, 1): 1, (1, 2): 5}, False)
    assert list(zip(i, j)) == [(0, 1), (1, 2)]
    assert match.heaviest_pairs(t1, np.array([0, 0]), t2, l2, 2, {}, True) == ([], [])


@given(st.lists(st.floats(-100, 100), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_isotonic_is_the_projection(y):
    y = np.array(y)
    fit, errors = isosplit._pooled(y)
    assert (np.diff(fit) >= -1e-9).all() and abs(fit.mean() - y.mean()) < 1e-6
    assert abs(((fit - y) ** 2).sum() - errors[-1]) < 1e-6
    for other in (np.sort(y), np.full(len(y), y.mean())):
        assert ((fit - y) ** 2).sum() <= ((other - y) ** 2).sum() + 1e-6


def test_isocut():
    rng = np.random.default_rng(0)
    assert isosplit.isocut(rng.standard_normal(400)) is None
    cut = isosplit.isocut(np.concatenate((rng.standard_normal(300), 8 + rng.standard_normal(200))))
    assert 2 < cut < 6
    assert isosplit.isocut(np.ones(50)) is None and isosplit.isocut(np.array([1.0, 2.0])) is None


def test_isosplit_three_squares():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.random((80, 2)) + c for c in ((0, 0), (4, 0), (0, 4))])
    label = isosplit.isosplit(x)
    assert len(set(label)) == 3 and all(len(set(label[i : i + 80])) == 1 for i in (0, 80, 160))
    assert isosplit.isosplit(x[:1]).tolist() == [1] and len(isosplit.isosplit(x[:0])) == 0


def test_components():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 4)) * np.array([5, 3, 1, 0.1])
    c, f = features.principal_components(x, 3, iterations=200)
    assert np.allclose(c.T @ c, np.eye(3), atol=1e-6) and np.allclose(f, x @ c)
    values = np.linalg.eigvalsh(x.T @ x)[::-1][:3]
    assert np.allclose((f**2).sum(axis=0), values, rtol=1e-4)


def test_overlap():
    rng = np.random.default_rng(3)
    apart = np.vstack((rng.standard_normal((50, 2)), 50 + rng.standard_normal((50, 2))))
    kind = np.repeat([0, 1], 50)
    assert features.neighbour_overlap(apart, kind, 6) == 0
    assert 0.3 < features.neighbour_overlap(rng.standard_normal((200, 2)), np.tile([0, 1], 100), 6) < 0.7


@pytest.mark.parametrize("seed", range(5))
def test_detect_against_a_plain_scan(seed):
    x = np.abs(np.random.default_rng(seed).standard_normal(500))
    expected, at, best = [], -1, 0.0
    for t, v in enumerate(x):
        if v < 1.5:
            continue
        if at >= 0 and t - at > 7:
            expected.append(at)
            at = -1
        if at < 0 or v > best:
            at, best = t, v
    expected.append(at)
    assert pursuit.detect(x, 1.5, 7).tolist() == expected


def test_pursuit_keeps_what_explains_energy():
    shape = np.outer([1.0, 0.5], np.hanning(11)) * 20
    x = np.random.default_rng(4).standard_normal((2, 400)) * 0.5
    for t in (100, 200, 204):
        x[:, t - 5 : t + 6] += shape
    times, labels = np.array([100, 101, 200, 204, 300, 2]), np.ones(6, int)
    kept = pursuit.pursue(x, times, labels, {1: shape}, 11, 30.0)
    assert kept.tolist() == [True, False, True, True, False, False]


@pytest.mark.parametrize("n", [1, 4, 60, 700])
def test_nearest_against_plain_distances(n):
    x = np.random.default_rng(n).integers(0, 3, (n, 4)).astype(float)
    y = x + 0.25
    for itself in (False, True):
        d = ((y[:, None] - x[None]) ** 2).sum(axis=2)
        if itself:
            np.fill_diagonal(d, np.inf)
        for i, (j, v) in enumerate(features.nearest(y, x, 5, itself, rows=100)):
            expected = np.argsort(d[i], kind="stable")[: min(5, n - itself)]
            assert j.tolist() == expected.tolist() and np.allclose(v, d[i, expected])


def test_pursuit_subtracts_the_scaled_template():
    shape = np.outer([1.0, 0.5], np.hanning(11)) * 20
    x = np.zeros((2, 200))
    x[:, 95:106] += 1.6 * shape
    assert pursuit.pursue(x, np.array([100, 101]), np.ones(2, int), {1: shape}, 11, 30.0).tolist() == [True, False]


def test_svm_separates():
    rng = np.random.default_rng(5)
    x = np.vstack((rng.standard_normal((80, 3)), rng.standard_normal((60, 3)) + [6, 0, 0])) * 100 + 50
    side = np.repeat([-1.0, 1.0], (80, 60))
    d, cut = svm.linear_svm(x, side)
    assert (np.sign(x @ d - cut) == side).mean() > 0.98 and abs(d[0]) > 5 * max(abs(d[1]), abs(d[2]))
    assert (svm.linear_svm(np.zeros((4, 2)), np.array([1.0, 1, -1, -1]))[0] == 0).all()


def test_pursuit_goes_on_until_nothing_is_left():
    from eventloom.kernels.pursuit import pursue

    shape = np.zeros((1, 8))
    shape[0, 2:5] = 10
    times = 10 + 4 * np.arange(120)  # a chain: each event overlaps the next
    x = np.zeros((1, 520))
    for t, scale in zip(times, np.linspace(3, 1, 120)):
        x[:, t - 3 : t + 5] += scale * shape
    assert pursue(x, times, np.ones(120, int), {1: shape}, 8, 5.0).sum() == 120


@given(st.lists(st.integers(-20, 20), min_size=1, max_size=25))
@settings(max_examples=100, deadline=None)
def test_down_up_against_every_split(y):
    y = np.array(y, float)
    fit = isosplit.down_up(y)
    every = [np.concatenate((-isosplit.isotonic(-y[:k]), isosplit.isotonic(y[k:]))) for k in range(len(y) + 1)]
    assert abs(((fit - y) ** 2).sum() - min(((f - y) ** 2).sum() for f in every)) < 1e-8
    assert any(np.allclose(fit, f) for f in every)
    errors, starts = isosplit._scan(y)
    for k in range(1, len(y) + 1):
        assert abs(errors[k - 1] - ((isosplit.isotonic(y[:k]) - y[:k]) ** 2).sum()) < 1e-8
        assert np.allclose(isosplit._blocks(np.concatenate(([0.0], np.cumsum(y))), starts, k), isosplit.isotonic(y[:k]))


def test_isosplit_keeps_the_centres_that_no_test_changed(monkeypatch):
    calls = {"geometric_median": 0, "isocut": 0}
    for name in calls:

        def counted(*args, name=name, run=getattr(isosplit, name)):
            calls[name] += 1
            return run(*args)

        monkeypatch.setattr(isosplit, name, counted)
    rng = np.random.default_rng(2)
    x = np.vstack((rng.standard_normal((200, 3)), rng.standard_normal((200, 3)) + 9))
    assert set(isosplit.isosplit(x)[:200]) & set(isosplit.isosplit(x)[200:]) == set()
    assert calls["isocut"] > 20 and calls["geometric_median"] <= 2 * calls["isocut"]


def test_consolidated_drops_what_is_stronger_elsewhere_or_off_centre():
    from eventloom.kernels.branch import consolidated

    clips = np.zeros((4, 9, 2))
    clips[0, 4], clips[1, 4], clips[2, 8], clips[3, 5] = (-5, 1), (5, 6), (7, 0), (3, 3)
    kept, peaks = consolidated(clips, np.arange(1, 5), 0, 0.9, 2)
    assert kept.tolist() == [1, 4] and peaks.tolist() == [5, 3]


def _plain_isocut(x, threshold, least):
    """The test as the reference states it, value by value."""
    x = np.sort(x)
    n = len(x)
    sizes = [s * 2**i for i in range(2, int(np.floor(np.log2(n // 2))) + 1) for s in (1, -1)] + [n]
    for size in sizes:
        part = x[:size] if size > 0 else x[size:]
        m = len(part)
        gaps = np.diff(part)

        def up_down(y):
            fits = [(isosplit.isotonic(y[: k + 1]), isosplit.isotonic(y[k:][::-1])[::-1]) for k in range(len(y))]
            losses = [((a - y[: k + 1]) ** 2).sum() + ((b - y[k:]) ** 2).sum() for k, (a, b) in enumerate(fits)]
            k = int(np.argmin(losses))
            return np.concatenate((fits[k][0], fits[k][1][1:]))

        fit = -up_down(-gaps)
        other = np.concatenate(([part[0]], part[0] + np.cumsum(fit)))
        ii, distance = 0, 0.0
        for j in range(m):
            while ii + 1 < m and part[ii + 1] <= other[j] + 1e-12:
                ii += 1
            distance = max(distance, abs(j / m - ii / m))
        if distance * np.sqrt(m) >= threshold and m >= 2 * least:
            excess = up_down(gaps / fit)
            at = least - 1 + int(np.argmax(excess[least - 1 : m - least]))
            return (part[at] + part[at + 1]) / 2
    return None


def test_isocut_is_the_test_of_the_reference():
    cuts = 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        x = np.concatenate((rng.standard_normal(60), rng.uniform(1, 5) + rng.standard_normal(rng.integers(5, 60)) * 0.3))
        cut, plain = isosplit.isocut(x, 1.2, 5), _plain_isocut(x, 1.2, 5)
        cuts += plain is not None
        assert cut == plain or abs(cut - plain) < 1e-9
    assert 5 < cuts < 40


def test_tested_pairs_within_the_tolerance_are_not_tested_again():
    tested = isosplit._Tested(2, 10, 0.2)
    a, b = np.array([0.0, 0.0]), np.array([10.0, 0.0])
    tested.add(a, b, 100, 50)
    assert tested.like(a + 0.1, b, 105, 50) and tested.like(b, a, 50, 100)
    assert not tested.like(a, b, 140, 50) and not tested.like(a + 0.3, b, 100, 50) and not tested.like(a, b, 50, 100)


def test_branch_splits_each_cluster_at_the_end(monkeypatch):
    from eventloom.kernels import branch

    rng = np.random.default_rng(3)
    x = np.vstack((rng.standard_normal((80, 4)), rng.standard_normal((80, 4)) + 9))
    alone = lambda f, threshold, seed=0: isosplit.isosplit(f, threshold, seed=seed) if seed else np.ones(len(f), int)
    monkeypatch.setattr(branch, "isosplit", alone)  # starts that find one cluster while branching
    label = branch.branch_cluster(x, np.ones(160))
    assert len(set(label)) == 2 and all(len(set(label[i : i + 80])) == 1 for i in (0, 80))


def test_shells_are_multiples_of_the_increment():
    from eventloom.kernels import branch

    assert branch._level(np.array([1.5, 1.9, 2.5, 3.5, 4.5, 4.6]), 1.0, 2) == 2.0
    assert branch._level(np.array([1.5, 1.9, 1.95]), 1.0, 2) is None
    clips = np.random.default_rng(0).standard_normal((30, 5, 3))
    assert np.allclose(branch.channel_features(clips, 2)[:, 2:4], features.principal_components(clips[:, :, 1], 2)[1])
