import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """duck(sql, sf_dir): the rows of a query over the tables of a folder."""
    import duckdb

    def run(sql, sf_dir):
        c = duckdb.connect()
        c.execute("SET TimeZone = 'UTC'")
        for f in sorted(os.listdir(sf_dir)):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
        out = c.execute(sql)
        return [d[0] for d in out.description], out.fetchall()

    return run


def rows_equal(df, names, rows):
    """Compares a DataFrame with rows of another engine, by column name and regardless of order."""
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    own = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    other = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows), key=repr)
    assert own == other
