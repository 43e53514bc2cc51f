import pytest

from quarrylight import scratch


class Session:
    """A session as far as ``scratch_dir`` looks at it."""

    def __init__(self, named, master):
        self.conf = type("C", (), {"get": lambda _, key, default=None: named})()
        self.sparkContext = type("S", (), {"master": master, "applicationId": "app"})()


def test_the_shared_folder_is_used():
    a, b = (scratch.scratch_dir(Session("hdfs://x/tmp/", "yarn")) for _ in range(2))
    assert a.startswith("hdfs://x/tmp/") and "//" not in a[7:] and a != b


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError):
        scratch.scratch_dir(Session(None, "spark://host:7077"))
    assert scratch.scratch_dir(Session(None, "local[2]")).startswith("file:///")
