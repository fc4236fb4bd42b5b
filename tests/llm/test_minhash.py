import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import minhash


def brute(rows, threshold=0.5, n=3):
    """Least id of each component of the exact similarity graph."""
    sets = {}
    for i, t in rows:
        if i is not None and t and t.split():
            sets.setdefault(i, []).append(minhash.word_runs(t, n))
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: find(i) for i in sets if find(i) != i}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.kept_id for r in minhash.near_groups(docs).collect()}
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    want = brute(list(zip(t["doc_id"], t["text"])))
    assert len(set(got.items()) & set(want.items())) >= 0.9 * len(want)
    assert not set(got) - set(want)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    base = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(1, None, 5), (2, "", 5), (3, "  \n ", 5), (4, base, 1), (4, base, 1), (5, base.upper(), 2), (6, base + " u", 3), (None, base, 4), (7, "one", 0), (8, "one", 0), (9, long, 0), (10, long + " tail", 0), (11, "x y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep int").withColumn("bands", F.lit(1)).withColumn("label", F.lit("x"))
    got = sorted((r.doc_id, r.kept_id) for r in minhash.near_groups(docs).collect())
    assert got == [(5, 4), (6, 4), (8, 7), (10, 9)]
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 2 3 4 7 9 11".split())
    assert minhash.near_groups(docs.where("false")).collect() == []
    assert minhash.drop_near_copies(docs.where("false")).collect() == []


@pytest.mark.parametrize("k", [0, 1, 77])
def test_coordinates_are_shifts_of_one_permutation(k):
    scatter, turned = perms = minhash.permutations()
    keys = np.array([3, 99, 2**40 + 5], np.uint64)
    size = 1 << minhash.UNIVERSE_BITS
    want = min(int(turned[(int(scatter[int(x) % size]) - k) % size]) for x in keys)
    assert minhash.signatures(keys, np.array([0, 3]), 80, perms)[0, k] == want


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (2, b), (2, c), (None, c + "more"), (None, a), (None, None), (None, None), (None, "d e f"), (None, "d e f"), (5, None), (5, None), (6, "d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in minhash.drop_near_copies(docs).collect()), key=str)
    groups = {"a": 0, "b": 0, "c": 0, "d": 0}
    for i, t in got:
        if t:
            groups[t[0]] += 1
    # One of each group of equal or near texts, whichever ids they have, and every row without a text.
    assert groups == {"a": 1, "b": 1, "c": 1, "d": 1}
    assert [x for x in got if not x[1]] == [(5, None), (None, None), (None, None)]
    assert (6, "d e f g") in got


def test_shared_runs_are_those_of_sets():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    a, b = ([" ".join(rng.choice(list("abc"), rng.integers(0, 30))) for _ in range(200)] for _ in range(2))
    na, nb, both = minhash.shared_runs(pa.array([*a, "x" * 9_000_000]), pa.array([*b, "y z"]), 3)
    for i in range(200):
        x, y = minhash.word_runs(a[i], 3), minhash.word_runs(b[i], 3)
        assert (na[i], nb[i], both[i]) == (len(x), len(y), len(x & y))


def test_many_documents_of_one_band_that_stay_apart(spark):
    """They share 24 of 42 runs, so bands hold thousands of them, and no two reach the threshold but those of the planted copies."""
    shared = " ".join(f"common{i}" for i in range(26))
    n = 100_000
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda k: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), k.cast("string"))), " ")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared + " "), own).alias("text"))
    copies = docs.where("doc_id % 1000 = 7").select((F.col("doc_id") + n).alias("doc_id"), F.concat("text", F.lit(" tail")).alias("text"))
    got = {(r.doc_id, r.kept_id) for r in minhash.near_groups(docs.unionByName(copies)).collect()}
    assert got == {(i + n, i) for i in range(7, n, 1000)}


def test_the_last_round_finds_what_stars_miss(spark):
    """Pairs within one band whose least member is like neither."""
    rng = np.random.default_rng(5)
    shared = [f"common{i}" for i in range(26)]
    rows = []
    for k in range(400):
        tail = [f"t{k}x{i}" for i in range(18)]
        rows += [(2 * k, " ".join(shared + tail)), (2 * k + 1, " ".join(shared + tail[: int(rng.integers(10, 17))] + ["end"]))]
    got = {r.doc_id: r.kept_id for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert len(set(got.items()) & set(want.items())) >= 0.95 * len(want) and not set(got) - set(want)
