import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    """Rows as comparable tuples, columns by name."""
    names = sorted(frame.columns)
    return sorted(tuple(str(v) for v in r) for r in frame[names].astype(object).where(frame[names].notna(), None).astype(str).replace({"<NA>": "None", "nan": "None"}).itertuples(index=False))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query with its SQL on the smallest tables."""
    import pandas as pd

    def check(query, sql):
        a, b = query(spark, SF).toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        for c in a.columns:  # whole numbers of either engine's type look alike
            for f in (a, b):
                if pd.api.types.is_float_dtype(f[c]) and f[c].dropna().mod(1).eq(0).all():
                    f[c] = f[c].astype("Int64")
        assert rows(a) == rows(b)

    return check
