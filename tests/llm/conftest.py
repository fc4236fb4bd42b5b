import pytest


def compare(spark, name, sf_dir):
    """Rows of a query and of its SQL, column names sorted, values as the driver sees them."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    order = ", ".join(f'"{n}"' for n in names)
    a = [tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()]
    b = con.sql(f"SELECT {order} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(a, key=str), sorted(b, key=str)


@pytest.fixture
def same(spark):
    def run(name, sf_dir="/root/testdata/sf0.001"):
        got, want = compare(spark, name, sf_dir)
        assert len(got) == len(want)
        assert got == want

    return run
