"""Distributed order statistics against plain sorting, with ties, NULLs and several buckets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaygrid.functions import ordering as O


def frame(spark, seed=0, n=3000, heavy=True):
    rng = np.random.default_rng(seed)
    v = np.round(rng.random(n), 3)
    if heavy:
        v[: n // 3] = 0.5  # one value holds a third of all rows
    key = np.where(rng.random(n) < 0.7, "big", "small")
    pdf = pd.DataFrame({"id": range(n), "k": key, "x": v})
    pdf.loc[pdf.sample(50, random_state=1).index, "x"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


@pytest.fixture(params=[200_000, 5])
def split(request, monkeypatch):
    """Run with one bucket and with many."""
    monkeypatch.setattr(O, "SPLIT_FROM", request.param)


def bh(p):
    n = len(p)
    o = np.argsort(-p, kind="stable")
    out = np.empty(n)
    out[o] = np.minimum.accumulate(p[o] * n / np.arange(n, 0, -1))
    return np.minimum(out, 1)


def step(p, method):
    n = len(p)
    o = np.argsort(p, kind="stable")
    out = np.empty(n)
    if method == "holm":
        out[o] = np.maximum.accumulate(p[o] * (n - np.arange(n)))
    elif method == "hochberg":
        out[o[::-1]] = np.minimum.accumulate((p[o] * (n - np.arange(n)))[::-1])
    elif method == "BY":
        return np.minimum(_by(p), 1)
    else:
        out = p * n
    return np.minimum(out, 1)


def _by(p):
    n = len(p)
    o = np.argsort(-p, kind="stable")
    out = np.empty(n)
    out[o] = np.minimum.accumulate(p[o] * n / np.arange(n, 0, -1) * np.sum(1 / np.arange(1, n + 1)))
    return out


@pytest.mark.parametrize("method", ["BH", "holm", "hochberg", "BY", "bonferroni"])
def test_adjust(spark, split, method):
    pdf, df = frame(spark)
    got = O.adjust_p(df, ["k"], "x", "adj", method).toPandas().set_index("id")
    for _, g in pdf.groupby("k"):
        ok = g.dropna()
        want = bh(ok.x.to_numpy()) if method == "BH" else step(ok.x.to_numpy(), method)
        assert np.allclose(got.loc[ok.id, "adj"].astype(float), want, atol=1e-12)
        assert got.loc[g[g.x.isna()].id, "adj"].isna().all()


def test_ranks_and_quantiles(spark, split):
    pdf, df = frame(spark, 2)
    got = O.average_ranks(df, ["k"], "x").toPandas().set_index("id")
    q = O.exact_quantiles(df, ["k"], "x", [0.0, 0.01, 0.5, 0.77, 1.0], list("abcde")).toPandas().set_index("k")
    grid = O.spread_quantiles(df, ["k"], "x", 11).toPandas()
    for k, g in pdf.groupby("k"):
        ok = g.dropna()
        assert np.allclose(got.loc[ok.id, "rank"].astype(float), ok.x.rank())
        assert np.allclose(q.loc[k, list("abcde")].astype(float), np.quantile(ok.x, [0, 0.01, 0.5, 0.77, 1]))
        mine = grid[grid.k == k].sort_values("i")
        assert np.allclose(mine["value"], np.quantile(ok.x, np.linspace(0, 1, 11)))


def test_quantile_without_keys(spark):
    pdf, df = frame(spark, 3)
    assert O.exact_quantiles(df, [], "x", [0.3], ["q"]).first()["q"] == pytest.approx(np.nanquantile(pdf.x, 0.3))


@pytest.mark.parametrize("method", ["BH", "hochberg", "holm"])
def test_adjustment_when_sketch_differs_at_each_reading(spark, monkeypatch, method):
    """On a cluster the parts of a sketch arrive in any order, so every evaluation may give other cuts."""
    real = F.percentile_approx
    noisy = lambda *a: F.transform(real(*a), lambda c: c + F.java_method(F.lit("java.lang.Math"), F.lit("random")).cast("double") * 0.02)
    monkeypatch.setattr(O, "SPLIT_FROM", 5)
    monkeypatch.setattr(O.F, "percentile_approx", noisy)
    pdf = pd.DataFrame({"id": range(2000), "p_value": np.random.default_rng(5).random(2000).round(4)})
    got = O.adjust_p(spark.createDataFrame(pdf).withColumn("k", F.lit("a")), ["k"], method=method, few=True).toPandas().sort_values("id")
    want = bh(pdf["p_value"].to_numpy()) if method == "BH" else step(pdf["p_value"].to_numpy(), method)
    np.testing.assert_allclose(got["adj_p_value"], want, rtol=1e-12)


@pytest.mark.parametrize("n", [0, 1, 11, 12, 13, 127])
def test_bucket_lookup_passes_strides(spark, n):
    """Cuts below a value, repeated cuts included, and never NULL."""
    cuts = sorted(float(x // 2) for x in range(n))
    values = [-1.0, 0.0, 0.5, 5.0, 6.0, 40.5, 63.0, 64.0, 99.0]
    df = spark.createDataFrame([(v, cuts) for v in values], "x double, cuts array<double>").select("x", O._cuts_below(F.col("cuts"), F.col("x")).alias("b"))
    assert not df.schema["b"].nullable
    assert {r.x: r.b for r in df.collect()} == {v: sum(c < v for c in cuts) for v in values}


def test_bandwidth_rows_stay_where_they_are(spark):
    """Few groups: their rows are not dealt by group, which would put each group into one task."""
    from assaygrid.operators.qc import bandwidths

    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("value"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = bandwidths(df, ["k"])
        joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        assert sum("SortMergeJoin" in x for x in joins) <= 1 < sum("BroadcastHashJoin" in x for x in joins)
        assert {r.k: r.n for r in out.collect()} == {0: 500, 1: 500}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
