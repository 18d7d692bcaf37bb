"""Every query with SQL gives the rows that DuckDB gives, over whole tables."""

import math

import duckdb
import pytest

from brocade.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name, tmp_path):
    made = QUERIES[name](spark, SF)
    assert len({c.lower() for c in made.columns}) == len(made.columns)
    made.write.parquet(str(tmp_path / "made"))  # as a user would: names that clash or types that can't be kept show here
    df = spark.read.parquet(str(tmp_path / "made"))
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    if name in ORACLE_SQL:
        r = duck.sql(ORACLE_SQL[name])
        assert sorted(r.columns) == columns
        assert len(set(r.columns)) == len(r.columns)
        at = [r.columns.index(c) for c in columns]
        assert got == sorted((tuple(same(x[i]) for i in at) for x in r.fetchall()), key=str)
