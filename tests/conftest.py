import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from carelens.session import local_session
    s = local_session("*", shuffle_partitions=8, app="carelens-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="carelens-test-ckpt-")})
    yield s
    s.stop()
