"""Branch clustering: recursive splitting of one channel's clips."""

from __future__ import annotations

import numpy as np

from eventloom.kernels.features import components_of
from eventloom.kernels.isosplit import isosplit


def features(x: np.ndarray, k: int) -> np.ndarray:
    return x @ components_of(x.T @ x, k)


def channel_features(x: np.ndarray, k: int) -> np.ndarray:
    """Features of each channel's own part of clips (events x samples x channels), one channel after the other."""
    return np.hstack([features(x[:, :, c], k) for c in range(x.shape[2])])


def _by_sign(x: np.ndarray, vectors: np.ndarray, peak: np.ndarray, **options) -> np.ndarray:
    label = np.zeros(len(x), int)
    for side in (peak < 0, peak >= 0):
        if side.any():
            label[side] = label.max() + _branch(x[side], vectors[side], np.abs(peak[side]), **options)
    return label


def _level(size: np.ndarray, increment: float, least: int) -> float | None:
    """The first multiple of the increment with at least so many sizes below it and so many not below."""
    size, level = np.sort(size), 0.0
    while level <= size[-1]:
        below = int(np.searchsorted(size, level))
        if len(size) - below < least:
            return None
        if below >= least:
            return level
        level += increment
    return None


def _branch(x: np.ndarray, vectors: np.ndarray, size: np.ndarray, n_features: int, threshold: float, increment: float, least: int) -> np.ndarray:
    """Labels 1, 2, ...: split until each part has one mode; a part of one mode is then looked at above a
    raised amplitude, and what lies below goes to the nearest centre of the clusters found there."""
    if len(x) < 2:
        return np.ones(len(x), int)
    label = isosplit(features(vectors, n_features), threshold)
    k = label.max()
    if k > 1:
        out, base = np.zeros(len(x), int), 0
        for j in range(1, k + 1):
            rows = label == j
            out[rows] = base + _branch(x[rows], vectors[rows], size[rows], n_features, threshold, increment, least)
            base = out.max()
        return out
    level = _level(size, increment, max(least, 1)) if increment > 0 else None
    if level is None:
        return label
    high = size >= level
    upper = _branch(x[high], vectors[high], size[high], n_features, threshold, increment, least)
    if upper.max() == 1:
        return label
    near = high & (size < level + increment)
    whole = np.zeros(len(x), int)
    whole[high] = upper
    centres = np.array([x[near & (whole == j)].sum(axis=0) / max(1, (near & (whole == j)).sum()) for j in range(1, upper.max() + 1)])  # zero for a cluster that has none in the next shell
    d = (x[~high] ** 2).sum(1)[:, None] - 2 * x[~high] @ centres.T + (centres**2).sum(1)
    whole[~high] = d.argmin(axis=1) + 1
    return whole


def _split(vectors: np.ndarray, label: np.ndarray, n_features: int, threshold: float) -> np.ndarray:
    """Each cluster clustered once more by itself, from other starts than those that found it."""
    out, base = np.zeros(len(label), int), 0
    for j in range(1, label.max() + 1):
        rows = label == j
        out[rows] = base + isosplit(features(vectors[rows], n_features), threshold, seed=1)
        base = out.max()
    return out


def branch_cluster(x: np.ndarray, peak: np.ndarray, n_features: int = 10, threshold: float = 1.5, increment: float = 0.0, least: int = 150, vectors: np.ndarray | None = None) -> np.ndarray:
    """Labels of clips (rows flattened over channels and time) with the given signed peaks: split by sign, branched
    and each cluster split at the end. ``vectors``: rows that are clustered in place of the clips themselves."""
    vectors = x if vectors is None else vectors
    label = _by_sign(x, vectors, peak, n_features=n_features, threshold=threshold, increment=increment, least=least)
    return _split(vectors, label, n_features, threshold) if len(label) else label


def consolidated(clips: np.ndarray, label: np.ndarray, own: int, factor: float, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, template peaks) of the clusters to keep; clips: events x samples x channels, own: the channel's column.
    Kept: energy on the own channel at least factor times the largest of the others, and the peak on the
    own channel within the interval of the centre."""
    mid = (clips.shape[1] + 1) // 2 - 1
    kept, peaks = [], []
    for k in np.unique(label).tolist():
        template = clips[label == k].mean(axis=0)
        energy = (template**2).sum(axis=0)
        at = int(np.abs(template[:, own]).argmax())
        if energy[own] >= factor * np.delete(energy, own).max(initial=0.0) and abs(at - mid) <= interval:
            kept.append(k)
            peaks.append(abs(template[at, own]))
    return np.array(kept, int), np.array(peaks, float)
