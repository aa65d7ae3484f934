from types import SimpleNamespace

import pytest

from voxloom.session import scratch_path


def session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: folder or default), sparkContext=SimpleNamespace(master=master)
    )


def test_scratch_is_below_the_shared_folder():
    first, second = (scratch_path(session("spark://host:7077", "s3a://shared/"), "x") for _ in range(2))
    assert first.startswith("s3a://shared/x-") and first != second


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(RuntimeError):
        scratch_path(session("spark://host:7077"), "x")
    assert "/x-" in scratch_path(session("local[2]"), "x")
