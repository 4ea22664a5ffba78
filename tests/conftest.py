"""One session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from objectlake.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("local[4]", 4, **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(shared), "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(x):
    """A value in a form that both engines share."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.6g}" if x != int(x) else int(x)
    if isinstance(x, (bytearray, memoryview)):
        return bytes(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def table_of(names: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return con


@pytest.fixture
def same_as_sql(spark, duck):
    def check(name: str) -> None:
        import __spark_entry__ as entry

        df = entry.queries()[name](spark, SF_DIR)
        got = table_of(df.columns, df.collect())
        found = duck.execute(entry.oracle_sql()[name])
        want = table_of([d[0] for d in found.description], found.fetchall())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return check
