import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brindle import reachable

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri()).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    reachable(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query's rows with its SQL's, whatever their order."""

    def check(df, sql):
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
        got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
        assert got == want
        return len(got)

    return check
