"""Unimodality in one dimension, and clustering that needs no number of clusters.

A sample comes from one mode if its spacings first shrink and then grow. The values that the best such fit
(isotonic down, then up) would give are compared with the sample by their Kolmogorov-Smirnov distance; where
it is too large the sample is cut where the spacings exceed the fit most. Clustering starts from many k-means
centres and tests pairs of neighbouring clusters along the line between them.
"""

from __future__ import annotations

import numpy as np


def isotonic(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Least-squares non-decreasing fit, by pooling adjacent violators."""
    return _pooled(y, w)[0]


def _pooled(y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The fit, and the squared error of the fit of each prefix."""
    w = np.ones(len(y)) if w is None else w
    mean: list[float] = []
    weight: list[float] = []
    count: list[int] = []
    loss: list[float] = []
    total, errors = 0.0, np.zeros(len(y))
    for i, (v, u) in enumerate(zip(y.tolist(), w.tolist())):
        m, s, n, e = v, u, 1, 0.0
        while mean and mean[-1] >= m:
            m0, s0, e0 = mean.pop(), weight.pop(), loss.pop()
            total -= e0
            e += e0 + (m - m0) ** 2 * s * s0 / (s + s0)
            m, s, n = (m * s + m0 * s0) / (s + s0), s + s0, n + count.pop()
        mean.append(m)
        weight.append(s)
        count.append(n)
        loss.append(e)
        total += e
        errors[i] = total
    return np.repeat(mean, count), errors


def _scan(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the non-decreasing fit of each prefix, the squared error and where its last block starts: the blocks
    before are those of the prefix that ends there, so every prefix's fit can be read off."""
    errors, starts, below = [0.0] * len(y), [0] * len(y), []
    m, s, n, e, total, under = np.inf, 0.0, 0, 0.0, 0.0, -np.inf  # the last block, and the mean of the one below
    for i, v in enumerate(y.tolist()):
        if v > m:
            below.append((under, s, n, e))
            under, m, s, n, e = m, v, v, 1, 0.0
        elif n:
            total -= e
            e += (v - m) * (v - m) * n / (n + 1)
            s, n = s + v, n + 1
            m = s / n
            while under >= m:
                mean = under
                under, s0, n0, e0 = below.pop()
                total -= e0
                e += e0 + (mean - m) * (mean - m) * n * n0 / (n + n0)
                s, n = s + s0, n + n0
                m = s / n
            total += e
        else:
            m, s, n = v, v, 1
        errors[i] = total
        starts[i] = i + 1 - n
    return np.array(errors), np.array(starts, int)


def _blocks(sums: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The fit of the first ``end`` values; sums: 0 and the cumulated values."""
    edges = [end]
    while edges[-1] > 0:
        edges.append(starts[edges[-1] - 1])
    edges = np.array(edges[::-1])
    length = np.diff(edges)
    return np.repeat(np.diff(sums[edges]) / length, length)


def _down_up(y: np.ndarray, down: tuple[np.ndarray, np.ndarray] | None = None, up: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Least-squares fit that falls, then rises; down and up: the scans of -y and of -y reversed, where known."""
    z = -y
    (e1, s1), (e2, s2) = down or _scan(z), up or _scan(z[::-1])
    cost = np.concatenate(([e2[-1]], e1[:-1] + e2[-2::-1], [e1[-1]]))
    at = int(np.argmin(cost))
    first, last = np.concatenate(([0.0], np.cumsum(z[:at]))), np.concatenate(([0.0], np.cumsum(z[at:][::-1])))
    return -np.concatenate((_blocks(first, s1, at), _blocks(last, s2, len(z) - at)[::-1]))


def up_down(y: np.ndarray) -> np.ndarray:
    """Least-squares fit that rises, then falls."""
    return -down_up(-y)


def down_up(y: np.ndarray) -> np.ndarray:
    return _down_up(y) if len(y) else y


def _distance(x: np.ndarray, fit: np.ndarray) -> float:
    """Kolmogorov-Smirnov distance of sorted values and those that the fitted gaps give."""
    other = np.maximum.accumulate(x[0] + np.concatenate(([0.0], np.cumsum(fit))))
    at = other + 1e-10 * (x[-1] - x[0])  # equal values stay equal however their sums are rounded
    return np.abs(np.searchsorted(x, at, "right") - np.searchsorted(other, at, "right")).max() / len(x)


def isocut(x: np.ndarray, threshold: float = 1.5, least: int = 4) -> float | None:
    """A cut point between two modes, or None. Heads and tails of 4, 8, 16, ... up to half of the values and then all
    of them are tested, so that a small mode beside a large one is seen; the first that fails decides."""
    x = np.sort(x)
    n = len(x)
    if n < 2 * least or x[0] == x[-1]:
        return None
    sizes = [s for s in (2**i for i in range(2, n.bit_length())) if 2 * least <= s <= n // 2]  # fewer cannot be cut
    every = np.diff(x)
    down, up = _scan(-every), _scan(-every[::-1])  # heads share the one, tails the other
    for start, end in [*(part for s in sizes for part in ((0, s), (n - s, n))), (0, n)]:
        part, gaps = x[start:end], every[start : end - 1]
        m = len(gaps)
        fit = _down_up(gaps, (down[0][:m], down[1][:m]) if start == 0 else None, (up[0][:m], up[1][:m]) if end == n else None)
        if _distance(part, fit) * np.sqrt(m + 1) >= threshold:
            excess = up_down(np.divide(gaps, fit, out=gaps.copy(), where=fit > 0))
            at = least - 1 + int(np.argmax(excess[least - 1 : m - least + 1]))
            return float((part[at] + part[at + 1]) / 2)
    return None


def kmeans(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm until nothing moves, from distinct rows drawn by the seed; labels 0, 1, ..., none of them empty."""
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    label, norm, last = np.full(len(x), -1), (x**2).sum(1)[:, None], np.inf
    while True:
        d = norm - 2 * x @ centres.T + (centres**2).sum(1)
        new = d.argmin(axis=1)
        loss = d[np.arange(len(x)), new].sum()
        if (new == label).all() or loss >= last:  # rounding alone could move rows for ever
            break
        label, last = new, loss
        order, size = np.argsort(label, kind="stable"), np.bincount(label, minlength=len(centres))
        some = np.flatnonzero(size)
        centres[some] = np.add.reduceat(x[order], (np.cumsum(size) - size)[some], axis=0) / size[some, None]
    return np.unique(label, return_inverse=True)[1]


def geometric_median(x: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Weiszfeld's iteration from the mean."""
    columns = np.ascontiguousarray(x.T)
    m = x.mean(axis=0)
    for _ in range(rounds):
        apart = columns - m[:, None]
        apart *= apart
        w = 1 / np.maximum(np.sqrt(apart.sum(axis=0)), 1e-12)
        m = columns @ w / w.sum()
    return m


def _medians(x: np.ndarray, start: np.ndarray, rounds: int = 10) -> np.ndarray:
    """The geometric medians of stretches of rows that begin at ``start``, all at once."""
    size = np.diff(np.append(start, len(x)))
    m = np.add.reduceat(x, start, axis=0) / size[:, None]
    for _ in range(rounds):
        apart = x - np.repeat(m, size, axis=0)
        w = 1 / np.maximum(np.sqrt(np.einsum("ij,ij->i", apart, apart)), 1e-12)
        m = np.add.reduceat(x * w[:, None], start, axis=0) / np.add.reduceat(w, start)[:, None]
    return m


def _line(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The direction between two clusters' means, whitened by their joint spread where it has rows enough."""
    m1, m2 = a.mean(axis=0), b.mean(axis=0)
    if a.shape[1] >= len(a) + len(b):
        return m2 - m1
    both = np.vstack((a - m1, b - m2))
    cov = both.T @ both / max(1, len(both) - 1)
    cov += np.eye(len(cov)) * (1e-6 * np.trace(cov) / len(cov) + 1e-12)
    return np.linalg.solve(cov, m2 - m1)


class _Tested:
    """Pairs of clusters that were tested: their centres and sizes, in both orders."""

    def __init__(self, dimensions: int, rounds: int, tolerance: float):
        self.first, self.second = np.zeros((2 * rounds, dimensions)), np.zeros((2 * rounds, dimensions))
        self.sizes, self.apart = np.zeros((2 * rounds, 2), int), np.zeros(2 * rounds)
        self.n, self.tolerance = 0, tolerance

    def add(self, c1: np.ndarray, c2: np.ndarray, n1: int, n2: int) -> None:
        at = slice(self.n, self.n + 2)
        self.first[at], self.second[at], self.sizes[at] = (c1, c2), (c2, c1), ((n1, n2), (n2, n1))
        self.apart[at] = np.linalg.norm(c1 - c2)
        self.n += 2

    def like(self, c1: np.ndarray, c2: np.ndarray, n1: int, n2: int) -> bool:
        """Whether a pair of about these sizes, with centres about here, was tested."""
        sizes, now = self.sizes[: self.n], np.array((n1, n2))
        at = np.flatnonzero((np.abs(sizes - now) <= self.tolerance * ((sizes + now) // 2)).all(axis=1) & (self.apart[: self.n] > 0))
        near = [np.linalg.norm(known[at] - c, axis=1) <= self.tolerance / np.sqrt(n) * self.apart[at] for known, c, n in ((self.first, c1, n1), (self.second, c2, n2))]
        return bool((near[0] & near[1]).any())


def isosplit(x: np.ndarray, threshold: float = 1.5, k_init: int = 30, seed: int = 0, rounds: int = 1000, tolerance: float = 0.2) -> np.ndarray:
    """Labels 1, 2, ... of rows: the closest pair of clusters not yet tested, within a tolerance of sizes and
    centres, either merges (one mode along the line between them) or exchanges the rows on the wrong side of the cut.

    Centres and distances are kept, and computed anew only for the clusters that a test changed."""
    if len(x) < 2:
        return np.ones(len(x), int)
    label = kmeans(x, k_init, seed)
    size = np.bincount(label)
    order, k = np.argsort(label, kind="stable"), len(size)
    start = np.cumsum(size) - size
    rows = np.split(order, start[1:])
    centre = _medians(x[order], start)
    size = size.tolist()
    tested = _Tested(x.shape[1], rounds, tolerance)
    d = ((centre[:, None] - centre[None]) ** 2).sum(axis=2)
    d[np.tril_indices(k)] = np.inf
    live = set(range(k))
    for _ in range(rounds):
        a, b = divmod(int(np.argmin(d)), k)
        while d[a, b] < np.inf and tested.like(centre[a], centre[b], size[a], size[b]):
            d[a, b] = np.inf
            a, b = divmod(int(np.argmin(d)), k)
        if d[a, b] == np.inf:
            break
        tested.add(centre[a], centre[b], size[a], size[b])
        d[a, b] = np.inf
        both, n = np.concatenate((rows[a], rows[b])), size[a]
        xs = x[both]
        on_line = xs @ _line(xs[:n], xs[n:])
        cut = isocut(on_line, threshold, 5)
        low = None if cut is None else on_line <= cut
        if low is None or low.all():
            rows[a], size[a] = both, len(both)
            live.discard(b)
            d[b, :] = d[:, b] = np.inf
            changed = [a]
        else:
            if low[:n].all() and not low[n:].any():
                continue
            rows[a], rows[b] = both[low], both[~low]
            size[a], size[b] = len(rows[a]), len(rows[b])
            changed = [a, b]
        for c in changed:
            centre[c] = geometric_median(x[rows[c]])
        for c in changed:
            far = ((centre - centre[c]) ** 2).sum(axis=1)
            for j in live:
                if j != c:
                    d[min(c, j), max(c, j)] = far[j]
    for j, c in enumerate(sorted(live), 1):
        label[rows[c]] = j
    return label
