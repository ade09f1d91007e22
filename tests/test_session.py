"""The shared folder, and what is left in it."""

import os
from types import SimpleNamespace

import pytest

from assaygrid import session


def fake(master, named=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(
        master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake(master))
    assert session.shared_folder(fake(master, "hdfs://x/y")) == "hdfs://x/y"


def test_scratch_leaves_nothing(spark):
    folder = session.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with session.scratch(spark):
        assert session.cut(session.cut(spark.range(10), "a").where("id > 3"), "b").count() == 6
        assert len(set(os.listdir(folder)) - before) == 2
    assert set(os.listdir(folder)) == before
