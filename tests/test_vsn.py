"""Variance-stabilising calibration: planted parameters, brute-force likelihood, partitioning."""

import numpy as np
import pytest

from assaygrid.model import make_layer
from assaygrid.operators import vsn


def planted(seed=1, features=900, samples=6, gaps=0.1, outliers=0.05):
    """y = (sinh(mu + noise) - a) / scale, some features off the model in one half of the samples."""
    rng = np.random.default_rng(seed)
    a, scale = rng.normal(0.3, 0.4, samples), np.exp(rng.normal(-1, 0.5, samples))
    mu = rng.normal(1.0, 1.6, features)
    h = mu[:, None] + rng.normal(0, 0.15, (features, samples))
    odd = rng.random(features) < outliers
    h[np.ix_(odd, np.arange(samples) < samples // 2)] += 2.0
    y = (np.sinh(h) - a) / scale
    y[rng.random(y.shape) < gaps] = np.nan
    return y, a, scale, odd


def layer_of(spark, y, parts=4):
    rows = [(f"f{i:05d}", f"s{j:02d}", float(v)) for (i, j), v in np.ndenumerate(y) if not np.isnan(v)]
    cells = spark.createDataFrame(rows, "feature_id string, sample_id string, value double").repartition(parts)
    samples = spark.createDataFrame([(f"s{j:02d}",) for j in range(y.shape[1])], "sample_id string")
    features = spark.createDataFrame([(f"f{i:05d}",) for i in range(len(y))], "feature_id string")
    return make_layer(cells, samples, features, "proteomics", "raw_intensity")


def test_planted_offsets_and_scales(spark):
    y, a, scale, odd = planted()
    found = vsn.calibrate(layer_of(spark, y))
    assert found.converged and found.passes < 150
    got = {r["sample_id"]: r for r in found.params.collect()}
    fit_a, fit_s = (np.array([got[f"s{j:02d}"][c] for j in range(6)]) for c in ("offset", "scale"))
    # Profiled means leave a small common factor; differences between samples are free of it.
    gap = np.log(fit_s / scale)
    assert gap - gap.mean() == pytest.approx(np.zeros(6), abs=0.03) and abs(gap.mean()) < 0.12
    assert fit_a == pytest.approx(a, abs=0.15)
    used = {r["feature_id"]: r["used"] for r in found.features.collect()}
    off = [used[f"f{i:05d}"] for i in np.flatnonzero(odd) if f"f{i:05d}" in used]
    assert np.mean(off) < 0.1 and np.mean(list(used.values())) == pytest.approx(0.9, abs=0.01)
    # The noise is even over the range of means, and large values read like log2 up to one shift.
    table = found.features.where("used").toPandas().sort_values("mean")
    low, high = table["variance"].head(180).median(), table["variance"].tail(180).median()
    assert 0.7 < low / high < 1.4
    cells = {(r[0], r[1]): r[2] for r in found.layer.cells.collect()}
    big = [(i, j) for (i, j), v in np.ndenumerate(y) if not np.isnan(v) and v > np.nanquantile(y, 0.98)]
    shift = [cells[f"f{i:05d}", f"s{j:02d}"] - np.log2(y[i, j] * scale[j]) for i, j in big]
    assert np.std(shift) < 0.1


def brute(y, x):
    """Negative profile log likelihood by plain loops."""
    size = y.shape[1]
    rss, jac, n = 0.0, 0.0, 0
    for row in y:
        at = np.flatnonzero(~np.isnan(row))
        u = np.exp(x[size + at]) * row[at] + x[at]
        h = np.arcsinh(u)
        rss += ((h - h.mean()) ** 2).sum()
        jac += (0.5 * np.log(1 + u * u) - x[size + at]).sum()
        n += len(at)
    return n / 2 * np.log(rss) + jac


def test_value_and_gradient_against_loops(spark):
    y, *_ = planted(2, 60, 4)
    layer = layer_of(spark, y)
    index = spark.createDataFrame([(f"s{j:02d}", j) for j in range(4)], "sample_id string, idx int")
    rows = vsn.feature_rows(layer.cells, index)
    x = np.array([0.1, -0.3, 0.2, 0.5, -1.0, -0.5, -1.2, 0.1])
    value, g, _ = vsn.objective(vsn.likelihood_sums(rows, x[:4], x[4:]), x[4:])
    assert value == pytest.approx(brute(y, x))
    for i in range(8):
        e = np.eye(8)[i] * 1e-5
        assert g[i] == pytest.approx((brute(y, x + e) - brute(y, x - e)) / 2e-5, rel=1e-4, abs=1e-4)


def test_same_result_for_any_partitioning_and_refusals(spark):
    y, *_ = planted(3, 200, 3)
    one, two = (vsn.calibrate(layer_of(spark, y, parts)).params.orderBy("sample_id").collect() for parts in (1, 7))
    for r, s in zip(one, two):
        assert r["offset"] == pytest.approx(s["offset"], abs=1e-6) and r["scale"] == pytest.approx(s["scale"], rel=1e-6)
    layer = layer_of(spark, y)
    with pytest.raises(ValueError):
        vsn.calibrate(layer.with_cells(layer.cells, "normalized_intensity"))
    unfinished = vsn.calibrate(layer, passes=2, trims=2)
    assert not unfinished.converged and unfinished.passes <= 4
    empty = layer_of(spark, y[:0])
    assert vsn.calibrate(empty).layer.cells.count() == 0
