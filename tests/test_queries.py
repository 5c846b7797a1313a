import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tidewatch.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in FOLDER.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return "nan" if math.isnan(v) else f"{float(v):.8g}"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_spark_and_sql_agree(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(FOLDER))
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.execute(catalog.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == names
    assert got == sorted(tuple(plain(r[at[c]]) for c in names) for r in found.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
