from pyspark.sql import functions as F

from quern.llm import lines
from quern.llm.shared import Scratch


def test_against_sql(same):
    same("op8_line_dedup")


def brute(rows, min_chars=1):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if t is None:
            out.append((i, t))
            continue
        keep, lost = [], 0
        for line in t.split("\n"):
            x = line.strip(lines.ENDS)
            if len(x) >= min_chars and x in seen:
                lost += 1
            else:
                keep.append(line)
                seen.add(x)
        if not lost or "".join(keep).strip(lines.ENDS):
            out.append((i, "\n".join(keep)))
    return out


def test_batches_and_fanout_dont_change_the_result(spark):
    rows = [(i, "\n".join(f"line number {(i * 7 + k * k) % 23}" for k in range(i % 6)) if i % 11 else None) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows, 5), key=str)
    for batches, fanout in ((1, 2), (3, 2), (5, 3)):
        got = lines.drop_repeated_lines(docs, batches=batches, fanout=fanout, min_chars=5)
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    # As many batches as the documents ask for.
    got = lines.drop_repeated_lines(docs, min_chars=5, batch_docs=12)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want


def test_short_lines_and_line_ends(spark):
    rows = [(1, "x\r\n\r\nyes"), (2, "\tx\n\nno\u00a0\n\x0c"), (3, "yes\n \n"), (4, "no")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.drop_repeated_lines(docs).collect())
    assert got == sorted(brute(rows)) == [(1, "x\r\n\r\nyes"), (2, "\nno\u00a0\n\x0c")]


def test_no_table_of_a_run_is_left_behind(spark):
    docs = spark.createDataFrame([(i, f"line {i % 3}") for i in range(9)], "doc_id long, text string")
    lines.drop_repeated_lines(docs).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_levels_hold_fewer_runs_than_the_fanout(spark):
    runs = lines.Runs(Scratch(spark, "levels"), 2, 2)
    for k in range(5):
        runs.add(spark.range(k * 10, k * 10 + 15).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("h"), F.col("id").alias("win")))
        runs.compact()
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    all_rows = [r.h for level in runs.levels for n in level for r in spark.table(runs._table(n)).collect()]
    assert len(all_rows) == len(set(all_rows)) == 55
    runs.drop()


def test_edge_cases(spark):
    a = "a line that is long enough"
    long = "\n".join(f"this is line number {i}" for i in range(30000))
    rows = [(1, None, 7), (2, "", 0), (3, f"{a}\nx\n  {a} ", 9), (4, a, 9), (4, a, 9), (None, f"{a}\nrest", 9), (5, f"{a}\n \n", 9), (6, "x\nx\nx", 5), (7, long, 1), (8, long + "\nnew line at the very end", 1), (9, "unique line which is twice here\nunique line which is twice here", 1), (9, "unique line which is twice here\nunique line which is twice here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumn("h", F.lit(1)).withColumn("at", F.lit("x"))
    got = lines.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    found = sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str)
    assert found == sorted([(1, None, 7), (2, "", 0), (3, f"{a}\nx", 28), (None, "rest", 4), (7, long, 1), (8, "new line at the very end", 24), (9, rows[-1][1].split("\n")[0], 31), (9, rows[-1][1].split("\n")[0], 31)], key=str)
    assert lines.drop_repeated_lines(docs.where("false")).collect() == []
