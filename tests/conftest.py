import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from blotter.session import get_session
    s = get_session("local[4]", app="blotter-tests", shuffle_partitions=8,
                    extra={"spark.driver.memory": "4g"})
    # tests own the checkpoint folder (a cluster would set spark.checkpoint.dir)
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="blotter-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()
