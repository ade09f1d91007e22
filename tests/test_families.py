"""Hommel against closed testing, q-values against their formula, density curves against the kernel sum."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from assaygrid.functions import families as FA
from assaygrid.functions import ordering as O


def closed_test(p):
    """Adjusted value of each hypothesis: the largest Simes p-value of all sets that hold it."""
    n, out = len(p), np.zeros(len(p))
    for k in range(1, n + 1):
        for some in combinations(range(n), k):
            q = np.sort(p[list(some)])
            simes = (k * q / np.arange(1, k + 1)).min()
            for i in some:
                out[i] = max(out[i], simes)
    return np.minimum(out, 1)


@pytest.mark.parametrize("split", [200_000, 3])
def test_hommel_is_the_closed_test(spark, monkeypatch, split):
    monkeypatch.setattr(O, "SPLIT_FROM", split)
    rng = np.random.default_rng(4)
    rows = []
    for f in range(12):
        p = rng.random(rng.integers(1, 10)) ** rng.choice([1, 2, 6])
        p = np.round(p, rng.choice([1, 3, 9]))
        rows += [(f"f{f}", i, float(x), float(a)) for i, (x, a) in enumerate(zip(p, closed_test(p)))]
    rows.append(("f0", 99, None, None))
    df = spark.createDataFrame(rows, "fam string, id long, p_value double, want double")
    got = O.adjust_p(df, ["fam"], method="hommel", few=True).toPandas()
    assert got["adj_p_value"].isna().sum() == 1
    got = got.dropna()
    assert got["adj_p_value"].to_numpy() == pytest.approx(got["want"].to_numpy(), abs=1e-12)


def test_hommel_of_one_long_family(spark, monkeypatch):
    monkeypatch.setattr(O, "SPLIT_FROM", 500)
    rng = np.random.default_rng(5)
    p = np.concatenate((rng.random(1500), rng.random(500) ** 8, [0.0, 1.0, 0.25, 0.25]))
    n, q = len(p), np.sort(p)
    simes = np.array([(i * q[n - i:] / np.arange(1, i + 1)).min() for i in range(1, n + 1)] + [0.0])
    want = [min(1.0, simes[0], min(max(simes[i], i * x) for i in range(1, n + 1))) for x in p]
    got = O.adjust_p(spark.createDataFrame(pd.DataFrame({"id": range(n), "p_value": p})), [], method="hommel").orderBy("id").toPandas()
    assert got["adj_p_value"].to_numpy() == pytest.approx(np.array(want), abs=1e-12)


def test_q_values(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate((rng.random(700), rng.random(300) ** 9))
    df = spark.createDataFrame(pd.DataFrame({"id": range(1000), "k": ["a"] * 990 + ["b"] * 10, "p_value": p}))
    got = FA.q_values(df, ["k"], few=True).toPandas().sort_values("id")
    for fam, part in got.groupby("k"):
        x, m = part["p_value"].to_numpy(), len(part)
        raw = np.array([(x >= c).sum() / (m * (1 - c)) for c in FA.CUTOFFS])
        share = np.clip(np.polyval(np.polyfit(FA.CUTOFFS, raw, 3), FA.CUTOFFS[-1]), 1 / m, 1)
        o = np.argsort(-x)
        bh = np.empty(m)
        bh[o] = np.minimum.accumulate(x[o] * m / np.arange(m, 0, -1))
        assert part["q_value"].to_numpy() == pytest.approx(share * bh, rel=1e-8)
        if fam == "a":
            assert 0.55 < share < 0.85


def test_density_curves(spark):
    from assaygrid.operators.qc import density_curves

    rng = np.random.default_rng(7)
    values = {"a": rng.normal(5, 1, 1500), "b": rng.gamma(2, 2, 700), "one": np.array([3.0])}
    rows = [(g, float(x)) for g, v in values.items() for x in v]
    got = density_curves(spark.createDataFrame(rows, "g string, value double").repartition(5), ["g"]).toPandas()
    every = np.concatenate(list(values.values()))
    for g in ("a", "b"):
        part, v = got[got["g"] == g].sort_values("i"), values[g]
        assert len(part) == 512 and part["x"].iloc[0] == every.min() and part["x"].iloc[-1] == pytest.approx(every.max())
        q1, q3 = np.quantile(v, [0.25, 0.75])
        h = 0.9 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2
        assert part["bandwidth"].iloc[0] == pytest.approx(h)
        direct = np.exp(-0.5 * ((part["x"].to_numpy()[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert part["density"].to_numpy() == pytest.approx(direct, abs=2e-3 * direct.max())
    assert got[got["g"] == "one"]["density"].isna().all()
    assert density_curves(spark.createDataFrame([], "g string, value double"), ["g"]).count() == 0
