import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def oracle():
    """compare(queries, sql, name, scale): Spark's rows against DuckDB's."""
    import math

    import duckdb

    def rows(frame, columns):
        def plain(v):
            if v is None or (isinstance(v, float) and math.isnan(v)):
                return None
            return float(v) if type(v).__name__ in ("Decimal", "float64", "float") else (int(v) if type(v).__name__.startswith("int") else str(v)[:19] if "Timestamp" in type(v).__name__ else v if isinstance(v, (bool, int)) else str(v))

        return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))

    def compare(spark, queries, sql, name, scale="sf0.001"):
        folder = TESTDATA / scale
        if not folder.exists():
            pytest.skip("no test data here")
        connection = duckdb.connect()
        for p in folder.glob("*.parquet"):
            connection.sql(f"create view {p.stem} as select * from '{p}'")
        got, want = queries[name](spark, str(folder)).toPandas(), connection.sql(sql[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        a, b = rows(got, columns), rows(want, columns)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and p == pytest.approx(q, abs=2e-6, rel=1e-9)) for p, q in zip(x, y)), (x, y)

    return compare
