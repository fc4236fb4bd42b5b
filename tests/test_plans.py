import duckdb
import pytest

from quern import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_against_its_sql(spark, sf_dir, name):
    df = plans.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=str)
    assert got
    if name not in plans.oracle_sql():
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql = plans.oracle_sql()[name]
    assert sorted(con.sql(sql).columns) == names
    order = ", ".join(f'"{n}"' for n in names)
    assert got == sorted(con.sql(f"SELECT {order} FROM ({sql})").fetchall(), key=str)
