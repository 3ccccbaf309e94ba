"""Order statistics by refinement against numpy."""

import numpy as np
import pytest

from parley.operators import profile as P

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("parts", [7, 1024])
def test_quantiles_equal_numpy(spark, monkeypatch, parts):
    monkeypatch.setattr(P, "RANGES", parts)
    rng = np.random.default_rng(parts)
    sets = {
        "ints": rng.integers(0, 30, 500).astype(float), "normal": rng.normal(0, 1e6, 501), "one": np.array([3.5]), "two": np.array([-1.0, 4.0]),
        "same": np.full(40, 7.0), "wide": np.array([-1e308, -1.0, 0.0, 5e-324, 1.0, 1e308]), "skewed": np.exp(rng.normal(0, 20, 300)),
    }
    rows = [(g, float(x)) for g, xs in sets.items() for x in xs] + [("ints", None), ("none", None), ("ints", float("nan"))]
    got = {(r["g"], r["q"]): r["quantile"] for r in P.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", QS).collect()}
    assert {g for g, _ in got} == set(sets)
    for g, xs in sets.items():
        xs = np.sort(xs)
        for q in QS:
            h = q * (len(xs) - 1)
            k = int(h)
            want = xs[k] + (h - k) * (xs[min(k + 1, len(xs) - 1)] - xs[k]) if h > k else xs[k]
            assert got[g, q] == want or (np.isinf(want) and np.isinf(got[g, q])), (g, q)
