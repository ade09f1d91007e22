"""Count models on planted negative-binomial data."""

import numpy as np
import pandas as pd
import pytest

from assaygrid.operators.diff import counts
from tests.test_layers import build


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    base = rng.uniform(50, 800, 300)
    mu = np.repeat(base[:, None], 12, axis=1) * rng.uniform(0.7, 1.4, 12)
    mu[:20, 6:] *= 3
    alpha = 0.05
    m = rng.negative_binomial(1 / alpha, 1 / (1 + alpha * mu)).astype(float)
    meta = pd.DataFrame({"grp": ["A"] * 6 + ["B"] * 6, "age": np.arange(12.0)})
    return build(spark, m, meta, "raw_count", "rnaseq")


C = [("B_vs_A", {"B": 1, "A": -1})]


@pytest.mark.parametrize("engine", ["wald", "ql"])
def test_planted_hits(planted, engine):
    run = counts.run_nb_wald if engine == "wald" else counts.run_ql
    r = run(planted, C).toPandas()
    r["planted"] = r.feature_id.isin([f"f{i}" for i in range(20)])
    hits = r[r.adj_p_value.astype(float) < 0.05]
    assert hits.planted.sum() == 20
    assert (~hits.planted).sum() <= 6
    assert r[r.planted].effect.astype(float).median() == pytest.approx(np.log2(3), abs=0.3)
    # The rest is close to uniform.
    p = r[~r.planted].p_value.astype(float)
    assert 0.35 < p.median() < 0.65


def test_swapped_contrast_negates(planted):
    a = counts.run_nb_wald(planted, C, filtering=False).toPandas().set_index("feature_id")
    b = counts.run_nb_wald(planted, [("A_vs_B", {"A": 1, "B": -1})], filtering=False).toPandas().set_index("feature_id").loc[a.index]
    assert np.allclose(a.effect.astype(float), -b.effect.astype(float), atol=1e-5)
    assert np.allclose(a.p_value.astype(float), b.p_value.astype(float), atol=1e-6)


def test_anova_agrees_with_two_groups(planted):
    a = counts.run_nb_anova(planted, ["A", "B"]).toPandas().set_index("feature_id").p_value.astype(float)
    w = counts.run_nb_wald(planted, C, filtering=False).toPandas().set_index("feature_id").p_value.astype(float)
    assert np.corrcoef(np.log(a + 1e-12), np.log(w.loc[a.index] + 1e-12))[0, 1] > 0.97


def test_size_factors_are_named(spark):
    m = np.random.default_rng(4).poisson(60, (24, 6)).astype(float)
    meta = pd.DataFrame({"grp": ["A"] * 3 + ["B"] * 3})
    method = lambda m, **k: {r.method for r in counts.run_nb_wald(build(spark, m, meta, "raw_count", "rnaseq"), C, filtering=False, **k).select("method").collect()}
    assert method(m) == {"deseq2"} and method(m, factors="library") == {"deseq2_library"}
    for i in range(24):
        m[i, i % 6] = np.nan
    with pytest.raises(ValueError, match="every sample"):
        method(m)
    assert method(m, factors="ratio_or_library") == {"deseq2_library"}


def negative_binomial(rng, mu, alpha=0.05):
    return rng.negative_binomial(1 / alpha, 1 / (1 + alpha * mu)).astype(float)


def lengths_of(spark, m):
    return spark.createDataFrame([(f"f{i}", f"s{j}", float(v)) for (i, j), v in np.ndenumerate(m)], "feature_id string, sample_id string, length double")


@pytest.mark.parametrize("engine", ["wald", "ql"])
def test_lengths_cancel(spark, engine):
    rng = np.random.default_rng(6)
    base = rng.uniform(80, 900, 200)
    length = rng.uniform(500, 3000, 200)[:, None] * np.ones(12)
    length[:60, 6:] *= rng.uniform(2.5, 4, 60)[:, None]  # another isoform in the second group, nothing else
    rel = length / np.exp(np.log(length).mean(axis=1, keepdims=True))
    m = negative_binomial(rng, base[:, None] * rel)
    layer = build(spark, m, pd.DataFrame({"grp": ["A"] * 6 + ["B"] * 6}), "raw_count", "rnaseq")
    run = (lambda **k: counts.run_nb_wald(layer, C, filtering=False, **k)) if engine == "wald" else (lambda **k: counts.run_ql(layer, C, **k))
    hits = lambda r: set(r[r.adj_p_value.astype(float) < 0.05].feature_id)
    longer = {f"f{i}" for i in range(60)}
    plain, flat = run().toPandas(), run(lengths=lengths_of(spark, np.full(m.shape, 700.0))).toPandas()
    assert len(hits(plain) & longer) > 50
    a, b = (r.set_index("feature_id").p_value.astype(float).sort_index() for r in (plain, flat))
    assert np.allclose(a, b, atol=1e-8, equal_nan=True)  # constant lengths change nothing
    known = run(lengths=lengths_of(spark, length)).toPandas()
    assert len(hits(known) & longer) <= 4
    assert abs(known[known.feature_id.isin(longer)].effect.astype(float).median()) < 0.1


def test_offsets_reach_the_likelihood():
    """One feature's coefficients against a grid over its likelihood with an offset of its own for every cell."""
    rng = np.random.default_rng(7)
    x = np.column_stack((np.ones(10), np.repeat([0.0, 1.0], 5)))
    off = rng.normal(0, 0.6, (1, 10))
    y = negative_binomial(rng, np.exp(4 + 0.8 * x[:, 1] + off), 0.1)
    alpha = np.array([0.1])
    beta, _, _ = counts.irls(y, x, off, alpha)
    best = max(((counts.log_lik(y, np.exp(x @ np.array([p, q]) + off), alpha)[0], p, q) for p in np.linspace(3, 5, 201) for q in np.linspace(0, 1.6, 161)))
    assert beta[0] == pytest.approx(best[1:], abs=0.011)


def test_outlier_counts(spark):
    rng = np.random.default_rng(8)
    for per, size in ((8, 16), (4, 8)):
        base = rng.uniform(60, 400, 150)
        m = negative_binomial(rng, np.repeat(base[:, None], size, axis=1))
        m[:10, size - 1] *= 60  # one wild count in the second group
        m[20:30, per:] = negative_binomial(rng, np.repeat(4 * base[20:30, None], size - per, axis=1))
        layer = build(spark, m, pd.DataFrame({"grp": ["A"] * per + ["B"] * per}), "raw_count", "rnaseq")
        r = {flag: counts.run_nb_wald(layer, C, filtering=False, outliers=flag).toPandas().set_index("feature_id") for flag in (True, False)}
        wild, real = [f"f{i}" for i in range(10)], [f"f{i}" for i in range(20, 30)]
        effect = lambda flag: r[flag].loc[wild].effect.astype(float).abs().median()
        p = r[True].loc[wild].p_value.astype(float)
        if per >= counts.REPLACE_FROM:
            assert effect(False) > 2 and effect(True) < 0.6 and (p > 0.01).sum() >= 8
        else:
            assert p.isna().sum() >= 8
        assert (r[True].loc[real].adj_p_value.astype(float) < 0.05).sum() >= 9
        rest = r[True].drop(wild).p_value.astype(float)
        assert rest.isna().sum() <= 8


def test_f_quantiles_and_dispersion_fallback(spark):
    # Table values of the F distribution.
    for q, d1, d2, want in ((0.99, 2, 10, 7.559), (0.99, 1, 5, 16.258), (0.95, 3, 20, 3.098), (0.99, 6, 4, 15.207)):
        assert counts.f_quantile(q, d1, d2) == pytest.approx(want, rel=2e-3)
    m = np.random.default_rng(9).poisson(np.linspace(500, 900, 40)[:, None] * np.ones(8)).astype(float)
    m = np.repeat(m.mean(axis=1, keepdims=True).round(), 8, axis=1)  # no spread at all, so no dispersion to follow a trend
    layer = build(spark, m, pd.DataFrame({"grp": ["A"] * 4 + ["B"] * 4}), "raw_count", "rnaseq")
    with pytest.warns(UserWarning, match="dispersion trend"):
        r = counts.run_nb_wald(layer, C, filtering=False).toPandas()
    assert len(r) == 40 and (r.p_value.astype(float) > 0.9).all()


def test_gamma_functions_of_positive_counts_only(monkeypatch):
    """A sparse layer's dispersions cost as much as its counts above zero, and are those of the plain likelihood."""
    from assaygrid.functions.tails import log_gamma

    rng = np.random.default_rng(4)
    y = rng.poisson(0.2, size=(60, 80)).astype(float)
    y[0] = 0.0
    mu, x, alpha = rng.uniform(0.1, 3, y.shape), np.ones((80, 1)), rng.uniform(0.01, 2, 60)
    a = 1 / alpha[:, None]
    plain = (log_gamma(y + a) - log_gamma(a + 0 * y) - log_gamma(y + 1.0) - a * np.log1p(alpha[:, None] * mu)
             + y * (np.log(alpha[:, None] * mu) - np.log1p(alpha[:, None] * mu))).sum(axis=1)
    assert np.allclose(counts.log_lik(y, mu, alpha), plain, rtol=1e-12)
    sizes = []
    monkeypatch.setattr(counts, "log_gamma", lambda v: sizes.append(np.size(v)) or log_gamma(v))
    counts.best_dispersion(y, x, mu)
    assert sum(sizes) <= 60 * ((y > 0).sum() + len(y))
