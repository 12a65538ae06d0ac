import sys
import tempfile

import pytest

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="tallyspark-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyspark-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tallyspark-test-", dir="/tmp")
