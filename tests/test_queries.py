"""Every query that has SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows_of(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else x
    return sorted(names), sorted((tuple(clean(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    answer = db.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in answer.description], answer.fetchall())
    got = entry.queries()[name](spark, SF)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want and want[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
