import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("TZ", "UTC")

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from issuegrid.session import checkpoint_dir, get_session

    s = get_session("local[*]", shuffle_partitions=8,
                    extra_conf={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="wh-", dir="/tmp")})
    checkpoint_dir(s, tempfile.mkdtemp(prefix="ckpt-", dir="/tmp"))
    yield s
    s.stop()
