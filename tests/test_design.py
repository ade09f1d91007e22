"""Needed samples of a design."""

import numpy as np

import pandas as pd
import pytest

from assaygrid.operators.diff.design import needed_samples, pairing_problems
from tests.test_layers import build


def test_needed_samples():
    two = np.column_stack((np.ones(9), [0.0] * 4 + [1.0] * 5))
    assert needed_samples(two) == 4 and needed_samples(np.ones((6, 1))) == 6
    assert needed_samples(np.column_stack((two, two[:, 1]))) == 4  # an aliased column changes nothing
    age = np.column_stack((np.ones(8), [1.0, 2, 3, 4, 5, 6, 7, 100]))
    hat = age @ np.linalg.inv(age.T @ age) @ age.T
    assert needed_samples(age) == int(np.ceil(1 / hat.diagonal().max())) == 2
    assert needed_samples(np.zeros((0, 2))) == 1


def test_pairing_rules(spark):
    meta = pd.DataFrame({"grp": ["A", "B", "A", "B", "B", "A", "C", "B", "C", "A", "A"], "donor": [1, 1, 2, 2, 2, 3, 3, 4, 4, 5, None]})
    layer = build(spark, np.ones((2, 11)), meta, "raw_intensity", "proteomics")
    told = lambda *a, **k: {int(r["donor"]): r["problem"] for r in pairing_problems(layer, "donor", *a, group_col="grp", **k).collect()}
    assert told(["A", "B"], control="A") == {2: "a group stands twice", 3: "only one group", 4: "only one group", 5: "only one group"}
    assert told(["A", "B", "C"], control="A") == {2: "a group stands twice", 4: "no control", 5: "only one group"}
    assert told(["A", "B", "C"]) == {2: "a group stands twice", 5: "only one group"}
    assert told() == {5: "fewer than two samples"}
    with pytest.raises(ValueError):
        pairing_problems(layer, "donor", ["B"], control="A")
