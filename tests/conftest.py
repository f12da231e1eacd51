import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from flicker.session import session

    s = session("tests", **{"spark.master": "local[4]", "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


def canonical(v):
    """Values of either engine in one form, doubles to 12 digits."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if isinstance(v, dict):
        return tuple(canonical(x) for x in v.values())
    if isinstance(v, float):
        return float(f"{v:.12g}")
    return v


def assert_same(df, duck, sql):
    """A query's rows equal those of its SQL, whatever their order."""
    cols = sorted(df.columns)
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(canonical(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(canonical(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want
