"""Small layers with all the awkward cases, checked by hand or by plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaygrid.model import make_layer
from assaygrid.operators import cells as C
from assaygrid.operators import gram as G
from assaygrid.operators import impute as I
from assaygrid.operators import normalize as N
from assaygrid.operators import qc as Q
from assaygrid.operators.diff import kernel, linear, ttest


def build(spark, m, meta, assay="normalized_intensity", omics="proteomics"):
    f, s = m.shape
    rows = [(f"f{i}", f"s{j}", float(m[i, j])) for i in range(f) for j in range(s) if not np.isnan(m[i, j])]
    cells = spark.createDataFrame(rows, "feature_id string, sample_id string, value double")
    samples = spark.createDataFrame(meta.assign(sample_id=[f"s{j}" for j in range(s)]))
    feats = spark.createDataFrame([(f"f{i}",) for i in range(f)], "feature_id string")
    return make_layer(cells, samples, feats, omics, assay, "grp", "A")


@pytest.fixture(scope="module")
def layer(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(20, 1, (40, 12))
    m[:5, 6:] += 4
    m[rng.random(m.shape) < 0.15] = np.nan
    m[10] = np.nan          # never seen
    m[11] = 7.0             # constant
    m[12, 6:] = np.nan      # one group only
    meta = pd.DataFrame({"grp": ["A"] * 6 + ["B"] * 6, "age": np.arange(12) * 1.5, "sex": ["m", "f"] * 6, "pair": list("uvwxyz") * 2})
    return m, meta, build(spark, m, meta)


def test_missing_and_absent(layer):
    m, _, y = layer
    got = C.feature_missing(y).toPandas().set_index("feature_id").missing_rate
    assert np.allclose([got[f"f{i}"] for i in range(40)], np.isnan(m).mean(1))
    assert C.absent_cells(y).count() == np.isnan(m).sum()
    g = C.group_missing(y, "grp").toPandas()
    assert len(g) == 80


def test_absent_cells_in_blocks(layer, monkeypatch):
    monkeypatch.setattr(C, "SAMPLES_PER_BLOCK", 5)
    m, _, y = layer
    assert C.absent_cells(y).distinct().count() == np.isnan(m).sum()


def ols(y, x):
    ok = ~np.isnan(y)
    xs, ys = x[ok], y[ok]
    b, _, rk, _ = np.linalg.lstsq(xs, ys, rcond=1e-10)
    rss = ((ys - xs @ b) ** 2).sum()
    df = ok.sum() - rk
    cov = np.linalg.pinv(xs.T @ xs)
    return b, np.sqrt(cov.diagonal() * rss / df), df


def test_lm_matches_least_squares(layer):
    m, meta, y = layer
    got = linear.run_lm(y, [("B", "A")], covariates=["age", "sex"]).toPandas().set_index("feature_id")
    x = np.column_stack([np.ones(12), meta.grp == "B", meta.age, meta.sex == "m"]).astype(float)
    for i in range(40):
        r = got.loc[f"f{i}"]
        if i in (10, 12):
            assert pd.isna(r.statistic)
            continue
        if i == 11:
            continue
        b, se, _ = ols(m[i], x)
        assert r.effect == pytest.approx(b[1], rel=1e-8)
        assert r.statistic == pytest.approx(b[1] / se[1], rel=1e-6)


def test_swapping_groups_negates(layer):
    _, _, y = layer
    a = ttest.run_ttest(y, [("B", "A")]).toPandas().set_index("feature_id")
    b = ttest.run_ttest(y, [("A", "B")]).toPandas().set_index("feature_id")
    assert np.allclose(a.effect.astype(float), -b.effect.loc[a.index].astype(float), equal_nan=True)
    assert np.allclose(a.p_value.astype(float), b.p_value.loc[a.index].astype(float), equal_nan=True)


def test_constant_shift_changes_nothing(layer):
    _, _, y = layer
    moved = y.with_cells(y.cells.withColumn("value", F.col("value") + 5))
    c = [("B_vs_A", {"B": 1, "A": -1})]
    a = linear.run_moderated(y, c).toPandas().set_index("feature_id").statistic.astype(float)
    b = linear.run_moderated(moved, c).toPandas().set_index("feature_id").statistic.astype(float)
    assert np.allclose(a, b.loc[a.index], equal_nan=True)


def test_two_group_anova_is_squared_t(layer):
    _, _, y = layer
    t = linear.run_moderated(y, [("B_vs_A", {"B": 1, "A": -1})]).toPandas().set_index("feature_id")
    f = linear.run_moderated_anova(y, ["A", "B"]).toPandas().set_index("feature_id").loc[t.index]
    assert np.allclose(t.statistic.astype(float) ** 2, f.statistic.astype(float), equal_nan=True)
    assert np.allclose(t.p_value.astype(float), f.p_value.astype(float), equal_nan=True)


def test_planted_features_come_first(layer):
    _, _, y = layer
    top = linear.run_moderated(y, [("B_vs_A", {"B": 1, "A": -1})]).orderBy("p_value").where("p_value is not null").limit(5).toPandas()
    assert set(top.feature_id) <= {f"f{i}" for i in range(5)} | {"f11"} or len(set(top.feature_id) & {f"f{i}" for i in range(5)}) >= 4


def test_paired_ttest(layer):
    m, meta, y = layer
    got = ttest.run_ttest(y, [("B", "A")], pair_col="pair").toPandas().set_index("feature_id")
    d = m[0, 6:] - m[0, :6]
    d = d[~np.isnan(d)]
    assert got.loc["f0"].statistic == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(len(d))))


def test_correlation_and_pca(layer):
    m, _, y = layer
    r = G.sample_correlation(y).toPandas()
    want = pd.DataFrame(m).corr()
    for a, b in ((0, 1), (3, 9)):
        got = r[(r.sample_a == f"s{a}") & (r.sample_b == f"s{b}")].r.iloc[0]
        assert got == pytest.approx(want.loc[a, b], abs=1e-10)
    scores, _ = G.pca(y, 2)
    x = np.where(np.isnan(m), np.nanmean(m, axis=1, keepdims=True), m)
    x = x[(~np.isnan(x).any(1))]
    x = x[x.std(1) > 0]
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    u, s, _ = np.linalg.svd(z.T, full_matrices=False)
    got = scores.toPandas().set_index("sample_id").loc[[f"s{j}" for j in range(12)], "PC1"].to_numpy()
    assert np.allclose(np.abs(got), np.abs(u[:, 0] * s[0]), atol=1e-8)


def test_tiles_give_the_same_correlation(layer, monkeypatch):
    _, _, y = layer
    whole = G.sample_correlation(y).toPandas().set_index(["sample_a", "sample_b"]).r
    monkeypatch.setattr(G, "TILE", 5)
    tiled = G.sample_correlation(y).toPandas().set_index(["sample_a", "sample_b"]).r
    assert np.allclose(whole, tiled.loc[whole.index], atol=1e-10)
    big, _ = G.pca(y, 2)
    monkeypatch.setattr(G, "TILE", 2048)
    small, _ = G.pca(y, 2)
    a, b = (d.toPandas().set_index("sample_id").sort_index().PC1 for d in (big, small))
    assert np.allclose(a, b, atol=1e-5)


def test_rank_rows_match_pandas():
    rng = np.random.default_rng(1)
    a = np.round(rng.random((20, 15)), 1)
    a[rng.random(a.shape) < 0.2] = np.nan
    assert np.allclose(kernel.average_rank_rows(a), pd.DataFrame(a).rank(axis=1), equal_nan=True)


def test_imputation_fills_every_gap(layer):
    m, _, y = layer
    for method in I.METHODS:
        out = I.impute(y, method).toPandas()
        assert len(out) == np.isnan(m).sum()
        assert out.value.notna().all()
    a, b = (I.impute(y, "MinProb", seed).toPandas().set_index(["feature_id", "sample_id"]).value.sort_index() for seed in (1, 1))
    assert a.equals(b)


def test_qc_drops_and_replays(spark, layer):
    m, meta, y = layer
    lin = build(spark, np.exp2(m), meta, "raw_intensity")
    clean, reports, rec = Q.run_qc(lin, 0.5, impute="MinDet")
    kept = (np.isnan(m).mean(1) <= 0.5).sum()
    assert clean.cells.count() == kept * 12
    assert Q.replay(lin, rec, check=True).cells.count() == kept * 12


def test_hashed_draws_ignore_partitioning(layer):
    _, _, y = layer
    a = I.min_prob(y).toPandas().set_index(["feature_id", "sample_id"]).value.sort_index()
    b = I.min_prob(y.with_cells(y.cells.repartition(7))).toPandas().set_index(["feature_id", "sample_id"]).value.sort_index()
    assert np.allclose(a, b)


def test_median_centering(layer):
    m, _, y = layer
    got = N.median_center(y).cells.toPandas().pivot(index="feature_id", columns="sample_id", values="value")
    med = got.median()
    assert np.allclose(med, med.iloc[0])


def test_random_block_recovers_correlation():
    rng = np.random.default_rng(8)
    blocks = np.repeat(np.arange(10), 3)
    same = ((blocks[:, None] == blocks) & ~np.eye(30, dtype=bool)).astype(float)
    x = np.column_stack([np.tile([1.0, 0, 0], 10), np.tile([0, 1.0, 1.0], 10)])
    y = rng.normal(size=(400, 30)) * np.sqrt(0.6) + rng.normal(size=(400, 10))[:, blocks] * np.sqrt(0.4)
    y[rng.random(y.shape) < 0.1] = np.nan
    assert np.nanmean(kernel.block_correlation(y, x, same)) == pytest.approx(0.4, abs=0.05)
    a, b = kernel.gls_fit(y, x, same, 0.0), kernel.sweep_fit(y, x)
    c = np.array([1.0, -1.0])
    assert np.allclose(a["beta"] @ c, b["beta"] @ c)
    assert np.allclose(a["rss"], b["rss"])


def test_neighbours_do_not_depend_on_tiles(spark, monkeypatch):
    """Brute force over all features, ties and empty features included, whatever the tile size."""
    import numpy as np

    from assaygrid.operators import impute

    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(240, 9)) + rng.normal(size=(240, 1)), 1)
    m[rng.random(m.shape) < 0.25] = np.nan
    m[200:220] = m[0]
    m[5], m[6, 1:], m[7] = np.nan, np.nan, 1.0
    ids = [f"f{i:03d}" for i in range(len(m))]
    want = {}
    center = np.nanmean(m, axis=0)
    for i in range(len(m)):
        seen = ~np.isnan(m[i])
        near = []
        if 2 * seen.sum() >= 9:
            both = seen & ~np.isnan(m)
            d = np.where(both, (m - m[i]) ** 2, 0.0).sum(axis=1) / np.maximum(both.sum(axis=1), 1)
            near = sorted((d[j], ids[j], j) for j in range(len(m)) if j != i and both[j].any())[:10]
        for s in np.flatnonzero(~seen):
            have = [m[j, s] for _, _, j in near if not np.isnan(m[j, s])]
            want[ids[i], f"s{s}"] = np.mean(have) if have else center[s]
    rows = [(ids[i], f"s{s}", float(m[i, s])) for i in range(len(m)) for s in range(9) if not np.isnan(m[i, s])]
    from assaygrid.model import make_layer

    layer = make_layer(spark.createDataFrame(rows, "feature_id string, sample_id string, value double"),
                       spark.createDataFrame([(f"s{s}",) for s in range(9)], "sample_id string"),
                       spark.createDataFrame([(i,) for i in ids], "feature_id string"), "proteomics", "normalized_intensity")
    for tile in (1024, 7):
        monkeypatch.setattr(impute, "NEIGHBOUR_TILE", tile)
        got = {(r.feature_id, r.sample_id): r.value for r in impute.nearest(layer).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
