"""Tests of whole operators on families that are cut into buckets, with a sketch that differs at each reading."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaygrid.functions import ordering as O
from assaygrid.model import make_layer
from assaygrid.operators.diff import linear, ttest


def results(spark, method):
    rng = np.random.default_rng(8)
    value = rng.normal(0, 1, (600, 9))
    cells = pd.DataFrame({"feature_id": np.repeat([f"f{i}" for i in range(600)], 9), "sample_id": [f"s{i}" for i in range(9)] * 600, "value": value.ravel()})
    samples = pd.DataFrame({"sample_id": [f"s{i}" for i in range(9)], "grp": list("abc") * 3})
    layer = make_layer(*map(spark.createDataFrame, (cells, samples, cells[["feature_id"]].drop_duplicates())), "proteomics", "normalized_intensity", "grp", "c")
    if method == "moderated":
        out = linear.run_moderated(layer, [("a_vs_c", {"a": 1, "c": -1}), ("b_vs_c", {"b": 1, "c": -1})])
    else:
        out = ttest.run_ttest(layer, [("a", "c"), ("b", "c")], var_equal=method == "pooled")
    return out.toPandas().sort_values(["comparison", "feature_id"])


@pytest.mark.parametrize("method", ["welch", "pooled", "moderated"])
def test_adjusted_p_of_cut_families(spark, monkeypatch, method):
    real = F.percentile_approx
    monkeypatch.setattr(O, "SPLIT_FROM", 5)
    monkeypatch.setattr(O.F, "percentile_approx", lambda *a: F.transform(
        real(*a), lambda c: c + F.java_method(F.lit("java.lang.Math"), F.lit("random")).cast("double") * 0.02))
    got = results(spark, method)
    for _, family in got.groupby("comparison"):
        p = np.sort(family.p_value.to_numpy())
        want = np.minimum(np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1)
        np.testing.assert_allclose(np.sort(family.adj_p_value.to_numpy()), want, rtol=1e-12)
