import numpy as np

from assaygrid.model import make_layer
from assaygrid.operators import impute


def _wanted(m, ids, k=10):
    center, want = np.nanmean(m, axis=0), {}
    for i in range(len(m)):
        seen = ~np.isnan(m[i])
        near = []
        if 2 * seen.sum() >= m.shape[1]:
            both = seen & ~np.isnan(m)
            d = np.where(both, (m - m[i]) ** 2, 0.0).sum(axis=1) / np.maximum(both.sum(axis=1), 1)
            near = sorted((d[j], ids[j], j) for j in range(len(m)) if j != i and both[j].any())[:k]
        for s in np.flatnonzero(~seen):
            have = [m[j, s] for _, _, j in near if not np.isnan(m[j, s])]
            want[ids[i], f"s{s}"] = np.mean(have) if have else center[s]
    return want


def test_buckets_give_what_all_pairs_give(spark, monkeypatch):
    """Many buckets and small leaves, with copies, ties, gaps, lone values and a far group."""
    rng = np.random.default_rng(8)
    m = np.round(rng.normal(size=(500, 6)), 2)
    m[rng.random(m.shape) < 0.2] = np.nan
    m[100:160] = m[rng.integers(0, 5, 60)]
    m[300:340] += 50
    m[400:410, 1:] = np.nan
    ids = [f"f{i:03d}" for i in rng.permutation(len(m))]
    layer = make_layer(
        spark.createDataFrame([(ids[i], f"s{s}", float(m[i, s])) for i, s in zip(*np.nonzero(~np.isnan(m)))], "feature_id string, sample_id string, value double"),
        spark.createDataFrame([(f"s{s}",) for s in range(6)], "sample_id string"), spark.createDataFrame([(i,) for i in ids], "feature_id string"),
        "proteomics", "normalized_intensity")
    want = _wanted(m, ids)
    monkeypatch.setattr(impute, "NEIGHBOUR_ROWS", 40)
    monkeypatch.setattr(impute, "NEIGHBOUR_TILE", 8)
    got = {(r.feature_id, r.sample_id): r.value for r in impute.nearest(layer).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_pairs_compared_grow_slower_than_all_pairs():
    """Twice the rows and targets would be four times the pairs if every target met every row."""
    def pairs(n):
        rng = np.random.default_rng(1)
        raw = rng.normal(size=(n, 5))
        leaves = impute._Leaves(np.array([f"f{i}" for i in range(n)], dtype=object), raw, 64)
        asked = raw[::10].copy()
        asked[:, 0] = np.nan
        i, d, j = leaves.nearest(asked, 11, np.full(len(asked), np.inf))
        for t in (0, 7):
            all_d = ((asked[t, 1:] - leaves.raw[:, 1:]) ** 2).sum(axis=1) / 4
            assert np.allclose(np.sort(all_d)[:11], d[i == t])
        return leaves.compared

    small, large = pairs(8000), pairs(32000)
    assert large < 32000 * 3200 / 4 and large < 10 * small
