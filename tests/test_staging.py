"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from leafmill import staging


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(session("yarn"))
    assert staging.shared_dir(session("yarn", "hdfs://x/y")) == "hdfs://x/y"
