import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quizloom.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    return local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _text(v):
    return "~" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def same(duck):
    """Whether a frame has the columns and rows of a SQL text."""

    def check(df, sql):
        found = duck.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        want = sorted(tuple(_text(r[names.index(c)]) for c in order) for r in found.fetchall())
        got = sorted(tuple(_text(r[c]) for c in order) for r in df.collect())
        assert got == want

    return check
