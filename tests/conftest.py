import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same_rows(df, con, sql):
    """Column names and rows (in any order) of a DataFrame and of SQL in DuckDB."""
    import tempfile
    from collections import Counter

    with tempfile.TemporaryDirectory() as d:
        df.write.parquet(f"{d}/out")
        want, got = con.sql(sql), con.sql(f"SELECT * FROM '{d}/out/*.parquet'")
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        names = ", ".join(f'"{c}"' for c in cols)
        a = Counter(map(str, con.sql(f"SELECT {names} FROM ({sql})").fetchall()))
        b = Counter(map(str, con.sql(f"SELECT {names} FROM '{d}/out/*.parquet'").fetchall()))
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
