"""The shared folder: never a machine's own folder on a cluster, and no local folder named after a scheme."""

import os
from types import SimpleNamespace

import pytest

from exemplar import session


def _fake(master, shared, files):
    conf = SimpleNamespace(get=lambda key, default=None: shared)
    context = SimpleNamespace(
        applicationId=f"app-{master}-{shared}",
        master=master,
        getConf=lambda: conf,
        getCheckpointDir=lambda: None,
        setCheckpointDir=files.append,
        addPyFile=files.append,
    )
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_fake("spark://host:7077", None, []))


def test_remote_folders_are_only_named(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    files = []
    fake = _fake("spark://host:7077", "hdfs://name/shared", files)
    assert session.checkpoint_dir(fake) == "hdfs://name/shared"
    assert session.scratch_path(fake, "x").startswith("hdfs://name/shared/x-")
    session.ship_package(fake)
    assert os.listdir(tmp_path) == []
    assert files[0] == "hdfs://name/shared" and os.path.isfile(files[-1]) and "://" not in files[-1]


def test_a_local_session_gets_a_scratch_folder():
    files = []
    fake = _fake("local[2]", None, files)
    assert os.path.isdir(session.checkpoint_dir(fake)) and session.checkpoint_dir(fake) == files[0]
