"""Linear support vector machines."""

from __future__ import annotations

import numpy as np


def linear_svm(x: np.ndarray, side: np.ndarray, c: float = 1.0, rounds: int = 60, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """(direction, cut) that separate rows of side -1 from those of side +1: x . direction - cut has the
    side's sign. Hinge loss with weight c, by coordinate descent on the dual in a fixed random order; rows
    are scaled by one common factor first, so that c means the same for any unit."""
    scale = float(np.sqrt((x * x).sum(axis=1).mean())) or 1.0
    z = np.hstack((x / scale, np.ones((len(x), 1))))
    square = (z * z).sum(axis=1)
    a, w = np.zeros(len(z)), np.zeros(z.shape[1])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(z)):
            new = min(max(a[i] - (side[i] * (w @ z[i]) - 1) / square[i], 0.0), c)
            if new != a[i]:
                w += (new - a[i]) * side[i] * z[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < tolerance:
            break
    return w[:-1] / scale, -float(w[-1])
