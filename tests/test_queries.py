"""Every registered query of the library against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from plansift.plans import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def listed(rows, names):
    return sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    if name not in ORACLE_SQL:  # these have brute-force tests in test_library.py
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert listed(got, names) == listed([dict(zip(names, r)) for r in found.fetchall()], names)
