"""The folder that driver and executors share."""

import pytest

from rasterloom import session


def bare(master, app="a"):
    return type("B", (), {"conf": type("C", (), {"get": staticmethod(lambda *_: None)}), "sparkContext": type("S", (), {"applicationId": app, "master": master, "getConf": staticmethod(lambda: {})})})


def test_bare_folders_are_qualified(spark):
    assert session.qualified(spark, "/some/where/") == "file:///some/where"
    assert session.qualified(spark, "hdfs://host/x/") == "hdfs://host/x"


def test_a_local_master_gets_a_folder_of_its_own():
    one = bare("local[4]")
    assert session.shared_dir(one) == session.shared_dir(one)
    assert session.shared_dir(one).startswith("file:///")


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://host"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(bare(master))
