import numpy as np
import pandas as pd
import pytest

from assaygrid.model import make_layer
from assaygrid.operators.diff import ttest
from assaygrid.operators.diff.results import pad_untested

COMPARISONS = [("a", "c"), ("b", "c"), ("d", "c")]


@pytest.fixture()
def layer(spark):
    rng = np.random.default_rng(3)
    samples = pd.DataFrame({"sample_id": [f"s{i}" for i in range(12)], "grp": list("abc") * 4})
    cells = pd.DataFrame([(f"f{f}", f"s{i}", float(rng.normal(f % 3, 1))) for f in range(40) for i in range(12) if rng.random() < 0.8],
                         columns=["feature_id", "sample_id", "value"])
    features = pd.DataFrame({"feature_id": [f"f{i}" for i in range(45)]})
    return make_layer(*map(spark.createDataFrame, (cells, samples, features)), "proteomics", "normalized_intensity", "grp", "c")


def test_cells_move_once(spark, layer):
    """Moments, contrasts and padding of a feature stay where its cells were sent."""
    stats = ttest.unpaired(layer, "grp", COMPARISONS)
    padded = pad_untested(layer, stats, [f"{a}_vs_{b}" for a, b in COMPARISONS])
    plan = padded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # cells by feature, features
    assert plan.count("Exchange hashpartitioning(feature_id") == 2


def test_every_feature_and_comparison_has_a_row(spark, layer):
    got = ttest.run_ttest(layer, COMPARISONS).toPandas()
    assert len(got) == 45 * 3 and not got.duplicated(["feature_id", "comparison"]).any()
    x = layer.cells.join(layer.samples, "sample_id").toPandas()
    assert got[got.comparison == "d_vs_c"].p_value.isna().all()
    assert got[got.feature_id.isin([f"f{i}" for i in range(40, 45)])].statistic.isna().all()
    for f in ("f0", "f7", "f39"):
        a, c = (x[(x.feature_id == f) & (x.grp == g)].value for g in "ac")
        row = got[(got.feature_id == f) & (got.comparison == "a_vs_c")].iloc[0]
        want = (a.mean() - c.mean()) / np.sqrt(a.var() / len(a) + c.var() / len(c))
        assert row.statistic == pytest.approx(want, rel=1e-10, nan_ok=True)


def test_rows_of_other_comparisons_stay_out(spark, layer):
    stats = spark.createDataFrame([("f1", "x", 1.0), ("f1", "y", 2.0), ("f2", "z", 3.0)], "feature_id string, comparison string, effect double")
    got = {(r.feature_id, r.comparison): r.effect for r in pad_untested(layer, stats, ["x", "z"]).collect()}
    assert len(got) == 90 and got[("f1", "x")] == 1.0 and got[("f2", "z")] == 3.0 and sum(v is not None for v in got.values()) == 2


def test_lines_of_the_test_layers_move_once(spark, sf):
    """Sums, marks, moments and padding of a part stay where its lines were sent, and library sizes read the same lines."""
    from assaygrid.plans import fixtures, testtables

    for layer, moves in ((testtables.prices(spark, sf), 1), (fixtures.counts_as_r(spark, sf), 2)):
        stats = ttest.unpaired(fixtures.planted(layer), "grp", fixtures.COMPARISONS)
        plan = stats._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.split("\n") if "Exchange hashpartitioning(feature_id" in x and "REPARTITION" in x]
        assert len(lines) == moves  # the second is the same lines, which the running query shuffles once
        assert not any(f"Exchange hashpartitioning({c}" in plan for c in ("l_partkey", "s_nationkey"))


def test_counts_under_their_own_ids(spark, sf):
    from assaygrid.plans import fixtures, testtables

    rows = lambda layer: {(r.feature_id[1:], r.sample_id, r.value) for r in layer.cells.collect()}
    own = fixtures.counts_as_r(spark, sf)
    assert rows(own) == rows(testtables.counts(spark, sf)) and own.cells.where("feature_id not like 'R%'").count() == 0
    assert own.features.where("feature_id not like 'R%'").count() == 0
