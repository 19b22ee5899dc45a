"""Detection and matching pursuit on one stretch of a series."""

from __future__ import annotations

import numpy as np


def detect(x: np.ndarray, threshold: float, interval: int) -> np.ndarray:
    """Greedy peaks of a non-negative signal: a sample at or above the threshold replaces the last peak if
    it is within the interval and strictly larger, and starts a new one if it is further away."""
    out: list[int] = []
    best, at = 0.0, -1
    for t in np.flatnonzero(x >= threshold).tolist():
        v = x[t]
        if at < 0 or t - at > interval:
            if at >= 0:
                out.append(at)
            best, at = v, t
        elif v > best:
            best, at = v, t
    if at >= 0:
        out.append(at)
    return np.array(out, int)


def strongest(template: np.ndarray, k: int = 8) -> np.ndarray:
    """The k channels (rows) of the largest peak magnitude."""
    return np.sort(np.argsort(-np.abs(template).max(axis=1), kind="stable")[:k])


def pursue(x: np.ndarray, times: np.ndarray, labels: np.ndarray, templates: dict[int, np.ndarray], clip_size: int, least: float) -> np.ndarray:
    """Which events are kept: in each round events whose template, as it is, removes at least ``least`` of
    energy, more than any other within a clip, are accepted, and the template, scaled to fit best on its
    strongest channels, is subtracted from x, until no event is left that removes enough."""
    x = x.copy()
    mid = (clip_size + 1) // 2 - 1
    n = x.shape[1]
    kept = np.zeros(len(times), bool)
    open_ = (times >= mid) & (times - mid + clip_size <= n)
    use = {k: strongest(t) for k, t in templates.items()}
    gain = np.zeros(len(times))
    dirty = open_.copy()
    while True:
        for i in np.flatnonzero(dirty & open_):
            t = templates.get(int(labels[i]))
            if t is None:
                open_[i] = False
                continue
            rows = use[int(labels[i])]
            clip, shape = x[rows, times[i] - mid : times[i] - mid + clip_size], t[rows]
            gain[i] = (clip**2).sum() - ((clip - shape) ** 2).sum()
        dirty[:] = False
        free = np.flatnonzero(open_ & (gain >= least))
        if not len(free):
            break
        order = free[np.argsort(times[free], kind="stable")]
        ts, g = times[order], gain[order]
        accept = []
        low, high = np.searchsorted(ts, ts - clip_size, "left"), np.searchsorted(ts, ts + clip_size, "right")
        for p in range(len(order)):
            before, after = g[low[p] : p], g[p + 1 : high[p]]
            if (not len(before) or before.max() < g[p]) and (not len(after) or after.max() <= g[p]):
                accept.append(order[p])
        for i in accept:
            rows = use[int(labels[i])]
            shape = templates[int(labels[i])][rows]
            at = slice(times[i] - mid, times[i] - mid + clip_size)
            power = (shape**2).sum()
            x[rows, at] -= ((x[rows, at] * shape).sum() / power if power else 1.0) * shape
            kept[i], open_[i] = True, False
            dirty |= np.abs(times - times[i]) < clip_size
    return kept
