from pathlib import Path
from types import SimpleNamespace

import pytest

from tidemill import session


def fake(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    runtime = SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__)
    return SimpleNamespace(conf=runtime, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=conf.get)))


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))


def test_the_named_folder_is_used():
    assert session.shared_dir(fake("yarn", "hdfs://shared/scratch/")) == "hdfs://shared/scratch"


def test_one_machine_chooses_a_folder_once():
    local = fake("local[4]")
    first = session.shared_dir(local)
    assert first == session.shared_dir(local) and Path(first).is_dir()


def test_scratch_is_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", [])
    written = session.materialize(spark.range(5), "scratch-test")
    assert written.count() == 5
    (path,) = session._WRITTEN
    session.clear_scratch(spark)
    assert session._WRITTEN == [] and not Path(path.removeprefix("file:")).exists()
