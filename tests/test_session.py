import pytest

from clearfold.session import cut, shared_dir


class Context:
    def __init__(self, master, directory=None):
        self.master, self.directory = master, directory

    def getCheckpointDir(self):
        return self.directory

    def setCheckpointDir(self, path):
        self.directory = path


class Session:
    def __init__(self, master, configured=None, directory=None):
        self.sparkContext = Context(master, directory)
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}


def test_the_configured_folder_wins():
    s = Session("spark://host", "hdfs://shared")
    assert shared_dir(s) == "hdfs://shared" and s.sparkContext.directory == "hdfs://shared"


def test_an_own_folder_only_on_a_local_master():
    assert shared_dir(Session("local[2]"))
    assert shared_dir(Session("spark://host", directory="hdfs://set")) == "hdfs://set"
    with pytest.raises(ValueError):
        shared_dir(Session("spark://host"))


def test_cut_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, ["a"], None), (2, [], "x")], "i int, a array<string>, s string")
    back = cut(df)
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == [(1, ["a"], None), (2, [], "x")]
    assert cut(df.limit(0)).count() == 0
