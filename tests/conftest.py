import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", f"{base}/local").config("spark.sql.warehouse.dir", f"{base}/warehouse").config("spark.checkpoint.dir", f"{base}/checkpoint").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same_rows(got, want):
    """Both pandas frames hold the same rows under the same names, in any order."""
    import pandas as pd

    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)

    def norm(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return f"{float(v):.9g}" if isinstance(v, float) or hasattr(v, "dtype") or isinstance(v, int) and not isinstance(v, bool) else str(v)

    rows = lambda df: sorted(tuple(map(norm, r)) for r in df[names].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
