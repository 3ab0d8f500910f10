"""The shared folder of intermediate tables."""

import pytest

from tessera import storage


class Session:
    """What shared_dir reads of a session."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()


def test_shared_dir():
    assert storage.shared_dir(Session("local[4]")).startswith("file://")
    assert storage.shared_dir(Session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            storage.shared_dir(Session(master))
