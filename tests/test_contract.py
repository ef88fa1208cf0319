"""The driver contract where a part is missing, and the shared folder."""

import sys

import pytest
from tessera.sources import shared


def test_a_broken_subpackage_leaves_the_other_queries(monkeypatch):
    import __spark_entry__ as e
    from tessera.plans.catalog import ORACLES, QUERIES

    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    with pytest.warns(UserWarning, match="left out"):
        assert set(e.queries()) == set(QUERIES)
    with pytest.warns(UserWarning, match="left out"):
        assert set(e.oracle_sql()) == set(ORACLES)


class Session:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.sparkContext = self.conf = self
        self.master, self.folder = master, None

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session("spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session("local-cluster[3,2,1024]"))
    assert shared.shared_folder(Session("local[2]"))
