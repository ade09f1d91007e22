"""Labels of repeated and blank ids."""

import pandas as pd

from assaygrid.operators.cells import unique_labels


def test_repeats_are_numbered_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = ["", None, "  "] * 400 + ["a"] * 30 + ["b", " b "] + [f"x{i}" for i in range(50)]
        rows = pd.DataFrame({"id": ids, "at": range(len(ids)), "label": "old"})
        frame = spark.createDataFrame(list(rows.itertuples(index=False, name=None)), "id string, at long, label string").repartition(6)
        got = unique_labels(frame, "id", ["at"]).toPandas().sort_values("at").reset_index(drop=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    base = pd.Series([("" if i is None else i).strip() or "._missing" for i in ids])
    nth = base.groupby(base).cumcount()
    assert list(got["label"]) == [b if n == 0 else f"{b}_{n}" for b, n in zip(base, nth)]
    assert list(got.columns) == ["id", "at", "label"]
