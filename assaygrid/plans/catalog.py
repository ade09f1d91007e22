"""All registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.operators import cells as C
from assaygrid.operators.diff import ttest
from assaygrid.operators.normalize import analysis_scale
from assaygrid.plans import catalog_core, catalog_diff, catalog_io, catalog_sets  # noqa: F401
from assaygrid.plans import testtables as TT
from assaygrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf):
    """Missingness filter, log scale, Welch test of two regions, BH, top 20 by adjusted p."""
    layer = TT.prices(spark, sf)
    layer = C.keep_features(layer, C.keep_by_missing(layer, 0.95))
    res = ttest.run_ttest(analysis_scale(layer), [("EUROPE", "MIDDLE EAST")])
    return res.where("p_value is not null").orderBy("adj_p_value", "p_value", "feature_id").limit(20)
