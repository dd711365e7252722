from types import SimpleNamespace

import pytest

from issuegrid.session import checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


def _fake(master, conf=None):
    ctx = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
    return SimpleNamespace(conf=_Conf(conf or {}), sparkContext=ctx)


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        checkpoint_dir(_fake("yarn"))


def test_cluster_folder_comes_from_the_session():
    assert checkpoint_dir(_fake("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})) == "hdfs:///shared/ckpt"


def test_local_runs_get_a_fallback_folder(tmp_path):
    spark = _fake("local[2]")
    assert checkpoint_dir(spark, str(tmp_path)) == str(tmp_path)
    assert spark.conf.get("spark.checkpoint.dir") == str(tmp_path)
