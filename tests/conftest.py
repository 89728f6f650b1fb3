import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sparkeda.session import checkpoint_dir, get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8)
    checkpoint_dir(s)  # unset in tests -> a scratch folder
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="sparkeda-test-")
