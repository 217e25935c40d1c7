"""Farthest-first order by blocks of centers against the plain loop."""

import numpy as np
import pytest

from siftwell.operators import scorers


def _plain(points):
    first = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order, gap = [first], ((points - points[first]) ** 2).sum(axis=1)
    for _ in range(len(points) - 1):
        gap[order] = -1.0
        order.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[order[-1]]) ** 2).sum(axis=1))
    return order


@pytest.mark.parametrize("sizes", [(1, 1), (3, 7), (64, 512)])
def test_order_is_that_of_the_plain_loop(monkeypatch, sizes):
    for name, n in zip(("CENTERS", "NEAR"), sizes, strict=True):
        monkeypatch.setattr(scorers, name, n)
    rng = np.random.default_rng(0)
    near = np.repeat(rng.normal(size=(90, 8)), 5, 0)
    for points in (rng.normal(size=(700, 64)), np.tile(np.eye(200), (4, 1)), rng.integers(0, 3, (600, 3)).astype(float), np.zeros((300, 4)), near, near + 1e6):
        assert scorers.kcenter_order(points) == _plain(points)


def test_all_points_meet_many_centers_at_once(monkeypatch):
    met, lower = [], scorers._lower
    monkeypatch.setattr(scorers, "_lower", lambda p, gap, which, c: met.append(len(c)) or lower(p, gap, which, c))
    scorers.kcenter_order(np.random.default_rng(0).normal(size=(3000, 64)))
    assert sum(met) == 2999 and len(met) < 2999 / 16
