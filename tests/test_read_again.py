"""Medians of averages and deviations, whose last bits may differ each time they are computed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaygrid.model import make_layer
from assaygrid.operators.impute import typical_spread
from assaygrid.operators.normalize import size_factors


def shaky(spark, features=150, samples=12):
    """A layer whose values differ in their last digits at every reading, and the values as a table."""
    values = np.random.default_rng(3).lognormal(5, 1, (features, samples))
    pdf = pd.DataFrame([(f"f{i}", f"s{j}", float(values[i, j])) for i in range(features) for j in range(samples)],
                       columns=["feature_id", "sample_id", "value"])
    random = F.java_method(F.lit("java.lang.Math"), F.lit("random")).cast("double")
    cells = spark.createDataFrame(pdf).withColumn("value", F.col("value") * (1 + 1e-11 * random))
    return make_layer(cells, spark.createDataFrame(pdf[["sample_id"]].drop_duplicates()),
                      spark.createDataFrame(pdf[["feature_id"]].drop_duplicates()), "proteomics", "raw_intensity"), values


def test_typical_spread(spark):
    layer, values = shaky(spark)
    for _ in range(6):
        assert typical_spread(layer).first()["spread"] == pytest.approx(np.median(values.std(axis=1, ddof=1)), rel=1e-9)


def test_size_factors(spark, monkeypatch):
    """Cells are written by their callers; the means over samples are the step's own. Without a broadcast they are read three times."""
    from assaygrid.session import cut

    layer, values = shaky(spark)
    logs = np.log(values)
    want = np.exp(np.median(logs - logs.mean(axis=1, keepdims=True), axis=0))
    fixed = cut(layer.cells)
    real = F.avg
    noisy = lambda c: real(c) + F.java_method(F.lit("java.lang.Math"), F.lit("random")).cast("double") * 1e-11
    monkeypatch.setattr(F, "avg", noisy)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.sample_id: r.size_factor for r in size_factors(layer.with_cells(fixed)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [got[f"s{j}"] for j in range(len(want))] == pytest.approx(list(want), rel=1e-9)
