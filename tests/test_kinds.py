"""Slots and entities that are equal are matched as one kind: at the same cost, and without a row of costs for each."""

import numpy as np

from corrobora.operators import identity as N
from corrobora.operators.assignment import assign


def test_equal_rows_at_least_cost():
    r = np.random.default_rng(0)
    for _ in range(150):
        n, m = r.integers(1, 12, 2)
        a, b = (r.integers(0, 3, (k, 3)).astype(float) * 0.7 for k in (n, m))
        cost = np.clip(np.sqrt(((a[:, None, :2] - b[None, :, :2]) ** 2).sum(axis=2)) + np.abs(a[:, None, 2] - b[None, :, 2]), 0.0, 1.5)
        got, want = N.matches(a[:, :2], a[:, 2:], b[:, :2], b[:, 2:], 1.0, 1.0, 1.5), assign(cost)
        assert len(got) == len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m)
        assert abs(sum(cost[i, j] for i, j in got) - sum(cost[i, j] for i, j in want)) < 1e-9


def test_copies_make_no_costs(monkeypatch):
    r = np.random.default_rng(1)
    place, at = r.uniform(0, 9, (30, 2)), r.uniform(0, 9, (70, 2))
    sizes, clip = [], np.clip
    monkeypatch.setattr(N.np, "clip", lambda x, *b: sizes.append(x.size) or clip(x, *b))
    many = N.matches(np.repeat(place, 50, axis=0), np.zeros((1500, 0)), np.repeat(at, 50, axis=0), np.zeros((3500, 0)), 1.0, 1.0, 5.0)
    assert len(many) == 1500 and sum(sizes) == 30 * 70
    far = lambda pairs, a, b: sum(min(5.0, float(np.hypot(*(a[i] - b[j])))) for i, j in pairs)
    once = N.matches(place, np.zeros((30, 0)), at, np.zeros((70, 0)), 1.0, 1.0, 5.0)
    assert abs(far([(i // 50, j // 50) for i, j in many], place, at) - 50 * far(once, place, at)) < 1e-6
