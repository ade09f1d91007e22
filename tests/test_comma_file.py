"""The decimal-comma folder is written by many tasks and reads back whole."""

import os

from assaygrid.plans import catalog_io as IO
from assaygrid.sources import layers as SL


def test_folder_in_parts(spark, sf, monkeypatch):
    whole = {(r.feature_id, r.sample_id): r.value for r in SL.read_layer(spark, IO._comma_file(spark, sf), "proteomics", transpose=False).cells.collect()}
    monkeypatch.setattr(IO, "ROWS_PER_FILE", 20, raising=False)
    path = IO._comma_file(spark, sf)
    assert sum(f.startswith("part-") for f in os.listdir(path)) > 3
    layer, report = SL.read_reported(spark, path, "proteomics")
    got = {(r.feature_id, r.sample_id): r.value for r in layer.cells.collect()}
    assert got == whole and got["#part", "N3"] == 1.5
    assert [r.name for r in report.collect() if r.action == "comment lines"] == ["30"]
