"""Small p-values of enrichment scores against enumeration and plain permutation."""

from itertools import combinations

import numpy as np
import pytest

from assaygrid.operators import rare_sets as R


def plain(places, a):
    """Enrichment score by walking the whole list."""
    inside = np.zeros(len(a), dtype=bool)
    inside[places] = True
    total, walk, hi, lo = a[inside].sum(), 0.0, -np.inf, np.inf
    for i in range(len(a)):
        if inside[i]:
            lo = min(lo, walk)
            walk += a[i] / total
            hi = max(hi, walk)
        else:
            walk -= 1 / (len(a) - len(places))
    return hi if hi >= -lo else lo


def test_scores_and_draws():
    rng = np.random.default_rng(1)
    a = rng.random(40) * 3
    sets = R.random_sets(rng, 40, 7, 50)
    assert (np.diff(sets, axis=1) > 0).all() and sets.min() >= 0 and sets.max() < 40
    assert R.scores_of(sets, a) == pytest.approx([plain(s, a) for s in sets])
    other = R.swapped(rng, sets, 40)
    assert (np.diff(other, axis=1) > 0).all() and ((other != sets).any(axis=1)).mean() > 0.5
    assert (np.diff(R.random_sets(rng, 400, 30, 20), axis=1) > 0).all()


def test_against_enumeration_near_one_in_a_million():
    rng = np.random.default_rng(2)
    n, k = 26, 7
    a = np.sort(np.abs(rng.normal(size=n)))[::-1] + 0.05
    every = np.concatenate([R.scores_of(np.array(list(part)), a) for part in np.array_split(np.array(list(combinations(range(n), k))), 20)])
    up = np.sort(every[every >= 0])
    exact = lambda t: (up >= t).mean()
    targets = np.array([np.quantile(up, q) for q in (0.5, 0.9, 0.99, 0.999, 0.9999)] + [up[-8], up[-2]])
    runs = np.array([R.multilevel(a, k, targets, np.random.default_rng(s), 151) for s in range(12)])
    assert exact(targets[-1]) < 4e-6
    for i, t in enumerate(targets):
        # The mean of twelve runs lies near the exact value; the error of a logarithm grows with the number of levels.
        assert np.log(runs[:, i].mean() / exact(t)) == pytest.approx(0, abs=0.12 + 0.1 * np.sqrt(-np.log2(exact(t))))


def test_against_plain_permutation_and_bounds():
    rng = np.random.default_rng(3)
    a = np.abs(np.sort(rng.normal(size=500))[::-1])
    null = R.scores_of(R.random_sets(rng, 500, 20, 20_000), a)
    up = null[null >= 0]
    targets = np.quantile(up, [0.3, 0.8, 0.97])
    got = np.mean([R.multilevel(a, 20, targets, np.random.default_rng(s)) for s in range(8)], axis=0)
    assert got == pytest.approx([(up >= t).mean() for t in targets], rel=0.35)
    assert R.multilevel(a, 20, np.array([2.0, 0.0]), np.random.default_rng(1), eps=1e-6) == pytest.approx([1e-6, 1.0])
    assert R.multilevel(a, 500, np.array([0.5]), rng) == pytest.approx([1.0])


def test_runs_share_and_partitioning(spark):
    rng = np.random.default_rng(4)
    score = np.sort(rng.normal(size=300))[::-1]
    ranked = [(c, i + 1.0, float(s)) for c in ("x", "y") for i, s in enumerate(score)]
    found = [("x", 12, 0.9), ("x", 12, 0.5), ("x", 12, -0.7), ("y", 12, 0.9), ("y", 30, 0.6), ("y", 30, 0.6)]
    one, two = (sorted(map(tuple, R.rare_p_values(
        spark.createDataFrame(found, "comparison string, set_size long, es double"),
        spark.createDataFrame(ranked, "comparison string, place double, score double").repartition(p), size=51).collect())) for p in (1, 5))
    assert one == two and len(one) == 5 and all(0 < r[3] <= 1 for r in one)
    by = {r[:3]: r[3] for r in one}
    assert by["x", 12, 0.9] < by["x", 12, 0.5] and by["x", 12, 0.9] < 1e-3
