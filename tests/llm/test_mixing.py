import math
from collections import defaultdict

from pyspark.sql import functions as F

from quern.llm import mixing


def test_against_sql_with_words_for_tokens(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = mixing.schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer=None)
    names = ", ".join(got.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(f"SELECT {names} FROM ({mixing.sql()})").fetchall())


def brute(rows, weights, share, seed=1):
    """(doc_id, source, tokens, finish, served) in order, one document after another."""
    from hashlib import md5

    from quern.llm.tokens import TOKENIZER, encode

    timed = []
    for source in {r[2] for r in rows}:
        total = 0
        own = [(md5(f"{seed}:{i}:{md5(t.encode()).hexdigest()}".encode()).hexdigest(), len(encode([t], TOKENIZER)[0]), i) for i, t, s in rows if s == source]
        for key, n, i in sorted(own):
            total += n
            timed.append((total / weights.get(source, 1.0), source, key, n, i))
    budget, served, out = math.floor(share * sum(t[3] for t in timed)), 0, []
    for finish, source, _, n, i in sorted(timed):
        served += n
        if served > budget:
            break
        out.append((i, source, n, finish, served))
    return out


def test_the_query_against_a_plain_loop_over_tokens(spark, sf_dir):
    from quern.llm import queries

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op10_mix_to_weights"](spark, sf_dir).orderBy("served", "finish", "source", "key").collect()
    assert [(r.doc_id, r.source, r.n_tokens, r.finish, r.served) for r in got] == brute(rows, mixing.WEIGHTS, 0.6)


def test_served_shares_follow_the_weights(spark):
    rows = [(i, "w " * (1 + i * 7 % 13), f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.schedule(docs, {"s0": 3.0, "s1": 1.0, "s2": 1.0}, share=0.4, bucket_rows=20, tokenizer=None).collect()
    by = defaultdict(int)
    for r in got:
        by[r.source] += r.n_tokens
    total = sum(by.values())
    assert abs(by["s0"] / total - 0.6) < 0.02 and abs(by["s1"] / total - 0.2) < 0.02
    got.sort(key=lambda r: r.served)
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    assert got[-1].served == total <= 0.4 * sum(len(t.split()) for _, t, _ in rows)
    kept = mixing.mixed(docs, weights={"s0": 3.0, "s1": 1.0, "s2": 1.0}, share=0.4, bucket_rows=20, tokenizer=None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (3, "one two", None), (4, "x " * 100000, "b"), (None, "y y y", "b"), (5, "gone", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit(1)).withColumn("weight", F.lit(2))
    got = {(r.doc_id, r.source): r.n_tokens for r in mixing.schedule(docs, {"none": 0.0}, share=1.0, tokenizer=None).collect()}
    assert got == {(1, "a"): 0, (2, "a"): 0, (3, ""): 4, (4, "b"): 100000, (None, "b"): 3}
    # The last blank is a token of its own.
    got = {(r.doc_id, r.source): r.n_tokens for r in mixing.schedule(docs, {"none": 0.0}, share=1.0).collect()}
    assert got == {(1, "a"): 0, (2, "a"): 0, (3, ""): 4, (4, "b"): 100001, (None, "b"): 3}
    kept = mixing.mixed(docs, weights={"none": 0.0}, share=1.0)
    assert kept.columns == docs.columns and kept.count() == 6
    assert mixing.schedule(docs.where("false")).collect() == []
    assert mixing.mixed(docs.where("false")).collect() == []
