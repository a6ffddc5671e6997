import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("checkpoints").as_uri())
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def run(sf_dir, sql):
        con = duckdb.connect()
        con.execute("SET threads = 2")
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return con.execute(sql).df()

    return run


@pytest.fixture(scope="session")
def same():
    import pandas as pd

    def plain(df):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            kind = str(df[c].dtype)
            if kind.startswith("datetime"):
                df[c] = df[c].astype("datetime64[us]").astype(str).replace("NaT", "None")
            elif "float" in kind or "int" in kind.lower():
                df[c] = df[c].astype("float64").round(5) + 0.0
            else:
                df[c] = df[c].map(lambda v: "None" if v is None or v is pd.NaT or v != v else str(v))
        return list(df.columns), sorted(map(repr, df.values.tolist()))

    def check(got, want):
        assert plain(got) == plain(want)

    return check
