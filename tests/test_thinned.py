"""Stretches of rings are thinned all at once, each as it would be alone."""

import numpy as np

from orograph.operators import rings


def alone(y, x, tolerance):
    kept, todo = set(), [(0, len(y) - 1)]
    while todo:
        a, b = todo.pop()
        away = []
        for k in range(a + 1, b):
            dy, dx = y[b] - y[a], x[b] - x[a]
            size = dy * dy + dx * dx
            t = min(1, max(0, ((y[k] - y[a]) * dy + (x[k] - x[a]) * dx) / size)) if size else 0
            away.append(np.hypot(y[k] - y[a] - t * dy, x[k] - x[a] - t * dx))
        if away and max(away) > tolerance:
            far = a + 1 + away.index(max(away))
            kept.add(far)
            todo += [(a, far), (far, b)]
    return kept


def test_stretches_are_thinned_at_once_as_alone():
    draw = np.random.default_rng(4)
    sizes = [2, 3, 1, 40, 2, 200, 5, 5]
    lines = [draw.integers(-3, 4, (n + 1, 2)).cumsum(axis=0).astype(float) for n in sizes]
    lines[6][-1] = lines[6][0]  # a closed one
    y, x = np.concatenate(lines).T
    last = np.cumsum([len(v) for v in lines]) - 1
    first = last - np.array(sizes)
    keep = rings._kept(y, x, first, last, 1.5)
    want = {f + k for f, v in zip(first, lines) for k in alone(*v.T, 1.5)}
    assert set(np.flatnonzero(keep)) == want and 20 < len(want) < len(y)
    assert not rings._kept(y[:2], x[:2], np.array([0]), np.array([1]), 1.5).any()
