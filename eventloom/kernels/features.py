"""Principal components and neighbours of small sets of vectors."""

from __future__ import annotations

import numpy as np

ITERATIONS = 10  # power iterations of a component


def principal_components(x: np.ndarray, k: int, iterations: int = ITERATIONS, subtract_mean: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions x k components, rows x k features) by power iteration and deflation from fixed starts, so
    the result repeats. Features are those of x itself, also where the components are of centred data."""
    base = x - x.mean(axis=0) if subtract_mean and len(x) else x
    return components_of(base.T @ base, k, iterations), x @ components_of(base.T @ base, k, iterations)


def components_of(moments: np.ndarray, k: int, iterations: int = ITERATIONS) -> np.ndarray:
    """The leading directions of a matrix of second moments, as columns."""
    c, d = moments.astype(float).copy(), len(moments)
    out = np.zeros((d, k))
    for j in range(min(k, d)):
        v = np.sin(np.arange(d) + 1.0)
        for _ in range(iterations):
            w = c @ v
            norm = np.linalg.norm(w)
            if norm == 0:
                v = np.zeros(d)
                break
            v = w / norm
        out[:, j] = v
        c -= (v @ c @ v) * np.outer(v, v)
    return out


def neighbour_overlap(features: np.ndarray, kind: np.ndarray, k: int) -> float:
    """The mean share of the k nearest others that are of another kind; exact distances, in blocks."""
    n = len(features)
    if n < 2:
        return 0.0
    k = min(k, n - 1)
    other = 0
    for start in range(0, n, 256):
        block = features[start : start + 256]
        d = ((block[:, None, :] - features[None]) ** 2).sum(axis=2)
        d[np.arange(len(block)), start + np.arange(len(block))] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        other += int((kind[near] != kind[start : start + 256, None]).sum())
    return other / (n * k)


def nearest(queries: np.ndarray, candidates: np.ndarray, k: int, itself: bool = False, rows: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns, squared distances) of the k nearest candidates of each query, equal distances in order of the
    candidates; ``itself``: query i is candidate i, which does not count.

    Matrix products propose all that may be among them, exact differences decide."""
    out, n = [], len(candidates)
    size = (candidates**2).sum(axis=1)
    groups = np.linspace(0, n, min(n, max(8 * k, 128)) + 1).astype(int)[:-1]
    for start in range(0, len(queries), rows):
        q = queries[start : start + rows]
        d = size - 2 * q @ candidates.T  # without the query's own norm, the same for all
        if itself:
            d[np.arange(len(q)), start + np.arange(len(q))] = np.inf
        low = np.minimum.reduceat(d, groups, axis=1)  # the k-th least of the groups' minima bounds the k-th least of all
        bound = np.partition(low, k - 1, axis=1)[:, k - 1] if len(groups) >= k else np.full(len(q), np.inf)
        slack = 1e-9 * (size.max() + (q**2).sum(axis=1))
        i, j = np.nonzero((d <= (bound + slack)[:, None]) & (d < np.inf))
        exact = ((q[i] - candidates[j]) ** 2).sum(axis=1)
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(q) + 1))
        out += [(j[a : min(a + k, b)], exact[a : min(a + k, b)]) for a, b in zip(first[:-1], first[1:])]
    return out
