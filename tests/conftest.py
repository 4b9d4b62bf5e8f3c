"""A session for all tests; its shared folder is new for each run."""

import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401
    from pagemill.session import local_session

    folder = tempfile.mkdtemp(prefix="pagemill-test-")
    session = local_session(8, spark_sql_shuffle_partitions="4", spark_checkpoint_dir=folder, spark_sql_warehouse_dir=f"{folder}/warehouse")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
