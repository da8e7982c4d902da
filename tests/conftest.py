import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from support import TABLES, TINY  # noqa: E402

from gristmill.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("4", 4, "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    return c
