"""Shared folders, bounds of broadcasts and numbered commits."""

from types import SimpleNamespace

import pytest

from tailrace import io


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        unset = SimpleNamespace(get=lambda *a: None)
        kept = {"spark.checkpoint.dir": folder}
        conf = SimpleNamespace(get=lambda k, d=None: kept.get(k, d), set=kept.__setitem__)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))

    for master in ("spark://h:7077", "yarn", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            io.shared_dir(session(master))
        assert io.shared_dir(session(master, "hdfs://n/shared/")) == "hdfs://n/shared"
    assert io.shared_dir(session("local[4]")).startswith("file://")


def test_small_is_bounded_by_rows_and_bytes(spark):
    df = spark.createDataFrame([(k, "x" * 100, ["y" * 50], None) for k in range(20)], "a int, b string, c array<string>, d string")
    assert io.small(df) is not df
    for bounds in ({"rows": 19}, {"size": 1000}):
        assert io.small(df, **bounds) is df
    assert io.small(df.limit(0)) is not None


def test_one_writer_takes_a_number(spark, tmp_path, monkeypatch):
    c = io.Commits(spark, str(tmp_path / "c"))
    assert c.last() is None
    c.publish(1, {"a": "é"})
    with pytest.raises(io.Taken):
        c.publish(1, {"a": 2})

    class Late:
        """A file system on which the other writer isn't seen yet."""

        def __init__(self, fs):
            self.fs = fs

        def exists(self, path):
            return False

        def __getattr__(self, name):
            return getattr(self.fs, name)

    real = io.hadoop
    monkeypatch.setattr(io, "hadoop", lambda s, p: (real(s, p)[0], Late(real(s, p)[1])))
    with pytest.raises(io.Taken):
        c.publish(1, {"a": 3})
    monkeypatch.setattr(io, "hadoop", real)
    c.publish(2, {"a": 4})
    assert c.last() == (2, {"a": 4})
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if not p.name.startswith(".")) == ["000000000001", "000000000002"]
