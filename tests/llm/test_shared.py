from pathlib import Path

from pyspark.sql import functions as F

from quern.llm import shared


def test_scratch_tables_are_removed(spark):
    before = list(shared._ROOTS)
    shared._ROOTS.clear()
    scratch = shared.Scratch(spark, "sweep")
    saved = scratch.save(spark.range(5), "a")
    scratch.save(spark.range(5), "b", "zstd")
    root = Path(scratch.root.removeprefix("file:"))
    assert saved.count() == 5 and {p.name for p in root.iterdir()} == {"a", "b"}
    scratch.drop("a")
    assert {p.name for p in root.iterdir()} == {"b"}
    shared.sweep(spark)
    assert not root.exists() and shared._ROOTS == []
    shared._ROOTS.extend(before)


def test_only_small_tables_are_sent_whole(spark):
    scratch = shared.Scratch(spark, "size")
    rows = scratch.save(spark.range(1000), "rows")
    hinted = lambda limit: "broadcast" in shared.sent_whole_if_small(rows, F.lit(24), limit)._jdf.queryExecution().logical().toString()
    assert hinted(24_000) and not hinted(23_999)
    assert "broadcast" in shared.sent_whole_if_small(rows.where("id < 0"), F.lit(24))._jdf.queryExecution().logical().toString()
