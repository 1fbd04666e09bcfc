"""One session for all tests, and DuckDB beside it."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from quillstack.session import session

    out = session("tests", **{"spark.master": "local[4]", "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    out.sparkContext.setLogLevel("ERROR")
    out.sparkContext.setCheckpointDir("file:///tmp/checkpoints")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def duck():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return out


def plain(frame):
    """Rows of a pandas frame as sorted tuples of texts, columns by name."""

    def cell(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "null"
        if isinstance(x, float):
            return str(int(x)) if x.is_integer() else f"{x:.6g}"
        return str(x)

    own = frame[sorted(frame.columns)]
    return sorted(tuple(cell(x) for x in row) for row in own.itertuples(index=False, name=None))
