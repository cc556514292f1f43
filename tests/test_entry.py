import duckdb
import pytest

import __spark_entry__
from barloom.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["user_id", "ts", "ma5", "upper", "above"]
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    QUERIES[name](spark, SMALL).write.parquet(str(tmp_path / "out"))
    con.sql(f"CREATE TABLE want AS {SQL[name]}")
    con.sql(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = sorted(c[0] for c in con.sql("DESCRIBE want").fetchall())
    assert columns == sorted(c[0] for c in con.sql("DESCRIBE got").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert con.sql(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b}").fetchall() == []
