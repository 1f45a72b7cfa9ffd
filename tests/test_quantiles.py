"""Quantiles of large groups equal those of the sorted values."""

import random

import pytest

from netgauge.operators import quantiles


@pytest.mark.parametrize("small", [20, 20_000])
def test_quantiles_of_groups_of_any_size(spark, monkeypatch, small):
    """Null keys and values, few and many different values, one value for most rows, infinities beside."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = random.Random(small)
    groups = {
        ("a", 1): [rng.random() for _ in range(3000)],
        ("a", 2): [rng.choice([0.0, 1.0]) for _ in range(1001)],
        (None, 1): [5.0] * 900 + [rng.random() * 10 for _ in range(300)],
        ("b", None): [rng.expovariate(1) for _ in range(700)] + [None] * 50,
        ("c", 3): [7.0],
        ("d", 4): [None, None],
    }
    rows = [(*k, x, None if x is None else -x) for k, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h int, x double, y double")
    targets = [("x50", "x", 0.5), ("x95", "x", 0.95), ("y0", "y", 0.0), ("y33", "y", 0.33)]
    got = {(r["g"], r["h"]): tuple(r)[2:] for r in quantiles.quantiles(df, ["g", "h"], targets).collect()}

    def plain(xs, p):
        xs = sorted(xs)
        at = (len(xs) - 1) * p
        low = int(at)
        return xs[low] + (at - low) * (xs[min(low + 1, len(xs) - 1)] - xs[low])

    want = {k: [x for x in xs if x is not None] for k, xs in groups.items()}
    assert set(got) == {k for k, xs in want.items() if xs}
    for k, qs in got.items():
        assert qs == pytest.approx((plain(want[k], 0.5), plain(want[k], 0.95), plain([-x for x in want[k]], 0.0), plain([-x for x in want[k]], 0.33)))
