import duckdb
import pytest

import __spark_entry__ as entry
from lexibond.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "part", "documents", "conversations", "nation")


@pytest.fixture(scope="module")
def con(tmp_path_factory):
    c = duckdb.connect(config={"temp_directory": str(tmp_path_factory.mktemp("duckdb")), "max_temp_directory_size": "1GB"})
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) > 0
    table = lambda df: sorted(df[columns].astype(str).itertuples(index=False, name=None))
    assert table(got) == table(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "decade", "w1", "w2", "llr", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
