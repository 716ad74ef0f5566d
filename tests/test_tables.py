import os

import pytest

from gleaner import tables


class Session:
    """A session that says what it runs on and no more."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf, self.folder = self, self, folder
        self.master = master

    def get(self, name, default=None):
        return self.folder or default

    def set(self, name, value):
        self.folder = value


def test_only_one_process_may_do_without_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(ValueError):
            tables.shared_folder(Session(master))
        assert tables.shared_folder(Session(master, "hdfs:///shared/")) == "hdfs:///shared"
    one = Session("local[4]")
    assert os.path.isdir(tables.shared_folder(one)) and tables.shared_folder(one) == one.folder


def test_written_tables_can_be_removed(spark):
    before = spark.range(5)
    found = tables.written(before, "five")
    assert found.count() == 5 and tables.few(found, 5) and not tables.few(found, 4)
    files = [f for f in found.inputFiles() if os.path.exists(f.removeprefix("file://"))]
    assert files
    tables.clean(spark)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
