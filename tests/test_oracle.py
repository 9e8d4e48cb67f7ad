"""Every registered query against its SQL, values and types."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from datamove.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ARROW = {"bigint": "int64", "int": "int32", "string": "string", "double": "double", "boolean": "bool", "date": "date32[day]", "timestamp_ntz": "timestamp[us]"}


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = _sorted(tuple(r[c] for c in columns) for r in df.collect())
    duck.execute(ORACLE[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    want = _sorted(tuple(row[names.index(c)] for c in columns) for row in duck.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_entry_and_registration(spark):
    rows = entry_module.entry(spark).collect()
    loaded, faulty = [r for r in rows if r.copy == "loaded"], [r for r in rows if r.copy == "faulty"]
    assert all(r.match for r in loaded)
    assert [r["check"] for r in faulty if not r.match] == ["row_checksum(5 columns)"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
