import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """SQL over the smallest tables."""
    import duckdb

    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return db


def plain(value):
    """Values that two engines agree on: whole numbers without a fraction, floats to nine digits."""
    if isinstance(value, float):
        return "null" if value != value else str(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value).lower() if value is not None else "null"
    return str(float(value)) if isinstance(value, int) else str(value)


def rows_of(rows, columns):
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)
