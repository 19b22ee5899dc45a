"""Greedy matching of two sorted lists of times."""

from __future__ import annotations

import numpy as np


def greedy_pairs(t1: np.ndarray, t2: np.ndarray, reach: int, wanted: np.ndarray | None, label2: np.ndarray) -> tuple[list[int], list[int]]:
    """One-to-one pairs: for offsets 0, 1, ... reach, each free event of t1 in order takes the first free
    event of t2 within the offset. With ``wanted``, events of that label of t2 are paired first."""
    free1, free2 = np.ones(len(t1), bool), np.ones(len(t2), bool)
    left: list[int] = []
    right: list[int] = []
    for agree in (True, False) if wanted is not None else (False,):
        for offset in range(reach + 1):
            low = np.searchsorted(t2, t1 - offset, "left")
            high = np.searchsorted(t2, t1 + offset, "right")
            for i in np.flatnonzero(free1 & (high > low)):
                for j in range(low[i], high[i]):
                    if free2[j] and (not agree or (wanted[i] > 0 and label2[j] == wanted[i])):
                        free1[i] = free2[j] = False
                        left.append(int(i))
                        right.append(j)
                        break
    return left, right


def heaviest_pairs(t1: np.ndarray, l1: np.ndarray, t2: np.ndarray, l2: np.ndarray, reach: int, counts: dict[tuple, int], counting: bool) -> tuple[list[int], list[int]]:
    """One-to-one pairs: each event of t1 in order takes the free event of t2 within reach whose label pair
    has the largest positive count. ``counting`` adds each look at a candidate to its pair's count."""
    counts = dict(counts)
    free = np.ones(len(t2), bool)
    low, high = np.searchsorted(t2, t1 - reach, "left"), np.searchsorted(t2, t1 + reach, "right")
    left: list[int] = []
    right: list[int] = []
    for i in range(len(t1)):
        best, at = 0, -1
        if l1[i] > 0:
            for j in range(low[i], high[i]):
                if free[j] and l2[j] > 0:
                    pair = (l1[i], l2[j])
                    if counting:
                        counts[pair] = counts.get(pair, 0) + 1
                    if (n := counts.get(pair, 0)) > best:
                        best, at = n, j
        if at >= 0:
            free[at] = False
            left.append(i)
            right.append(at)
    return left, right
