"""The folder for written tables where a local master names none."""

import os
from types import SimpleNamespace

import pytest

from seqgrid.llm import common


def session(master, path=None):
    def refuse(*_):
        raise AssertionError("Spark lets nobody change it")

    conf = SimpleNamespace(get=lambda key, default=None: path or default, set=refuse)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="test-app"))


def test_local_master_without_a_folder():
    made = common.shared_dir(session("local[2]"))
    assert os.path.isdir(made) and common.shared_dir(session("local[2]")) == made


def test_named_folder_and_cluster():
    assert common.shared_dir(session("spark://x", "hdfs://y/z/")) == "hdfs://y/z"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://x"))
