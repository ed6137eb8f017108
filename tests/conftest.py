import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from blockloom.plans.shipping import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return f"{x:.9g}" if isinstance(x, float) else x


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compares a query's rows, names and order of columns aside, with its SQL's."""

    def check(query, sql):
        got = query(spark, SF)
        rel = duck.sql(sql)
        names = sorted(got.columns)
        assert names == sorted(rel.columns)
        key = lambda r: [(v is not None, str(v)) for v in r]
        a = sorted(([plain(r[n]) for n in names] for r in got.collect()), key=key)
        b = sorted(([plain(r[rel.columns.index(n)]) for n in names] for r in rel.fetchall()), key=key)
        assert a == b

    return check
