"""Minimum-cost assignment."""

from __future__ import annotations

import numpy as np


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), as many as the smaller side, of the least total cost; successive shortest paths
    with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for start in range(n):
        least = np.full(m, np.inf)
        came = np.full(m, -1)
        done = np.zeros(m, bool)
        row, column = start, -1
        while True:
            slack = c[row] - u[row] - v
            better = ~done & (slack < least)
            least[better], came[better] = slack[better], column
            nxt = int(np.argmin(np.where(done, np.inf, least)))
            step = least[nxt]
            u[start] += step
            seen = np.flatnonzero(done)
            u[row_of[seen]] += step
            v[seen] -= step
            least[~done] -= step
            done[nxt] = True
            column = nxt
            if row_of[nxt] < 0:
                break
            row = row_of[nxt]
        while column >= 0:
            before = came[column]
            row_of[column] = start if before < 0 else row_of[before]
            column = before
    pairs = [(int(r), j) for j, r in enumerate(row_of) if r >= 0]
    return sorted((j, r) for r, j in pairs) if flip else sorted(pairs)
