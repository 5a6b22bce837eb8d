"""Helpers of the corpus operators."""

import pytest

from confera.llm import common


class _Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, found):
        self.dir = found


class _Session:
    def __init__(self, master, found=None):
        self.sparkContext, self.settings, self.conf = _Context(master), {"spark.checkpoint.dir": found} if found else {}, self

    def get(self, key, default):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_shared_folder_is_the_sessions_or_an_error():
    assert common.shared_dir(_Session("spark://a:7077", "file:///shared")) == "file:///shared"
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(_Session(master))
    own = _Session("local[4]")
    assert common.shared_dir(own).startswith("file://") and own.sparkContext.dir == common.shared_dir(own)
