from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    """Rows in any order: columns by name, numbers to six digits."""
    df = df[sorted(df.columns)]
    out = [tuple(_value(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: repr(tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r)))
