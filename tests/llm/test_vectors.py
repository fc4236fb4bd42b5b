import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quern.llm import vectors
from quern.llm.shared import Scratch


def made(n=1500, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(n // 3):
        x[n // 2 + k] = x[k % 200] + rng.normal(size=dim) * rng.uniform(0.05, 0.55)
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, x):
    return spark.createDataFrame([(i, v.astype(np.float32).tobytes()) for i, v in enumerate(x)], "id long, vec binary")


def test_recall_of_pairs_against_brute_force(spark):
    x = made()
    cosine = x @ x.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(cosine, 1) >= 0.9))}
    got = {(r.a, r.b): r.cosine for r in vectors.near_pairs(frame(spark, x), Scratch(spark, "v"), 0.9, 8, 64).collect()}
    assert len(want) > 300
    assert len(want & set(got)) >= 0.9 * len(want)
    assert all(abs(c - cosine[p]) < 1e-5 and c >= 0.9 for p, c in got.items())


def test_recall_of_groups_on_a_larger_table(spark):
    """30,000 vectors with planted near copies, in lists of which one holds a third of all, searched in blocks."""
    rng = np.random.default_rng(4)
    n = 30_000
    x = rng.normal(size=(n, 64))
    x[: n // 3] = 3 * x[0] + rng.normal(size=(n // 3, 64))
    x[n - 4000 :] = x[rng.integers(n // 3, n // 2, 4000)] + rng.normal(size=(4000, 64)) * rng.uniform(0.05, 0.45, (4000, 1))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    label = np.arange(n)
    pairs = 0
    for lo in range(0, n, 1000):
        i, k = np.nonzero(x[lo : lo + 1000] @ x.T >= 0.9)
        pairs += ((i + lo) < k).sum()
        label = vectors.united(label, i + lo, k)
    want = {(i, int(label[i])) for i in np.flatnonzero(label != np.arange(n))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    before = vectors.MEMBERS, vectors.QUERIES
    vectors.MEMBERS, vectors.QUERIES = 60, 400
    try:
        got = {(r.vec_id, r.kept_id) for r in vectors.near_groups(df).collect()}
    finally:
        vectors.MEMBERS, vectors.QUERIES = before
    assert len(want) > 3000
    assert len(got & want) >= 0.9 * len(want) and len(got) <= len(want) / 0.9


def test_united_labels_are_components():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n, m = 40, int(rng.integers(0, 60))
        i, k = rng.integers(0, n, m), rng.integers(0, n, m)
        label = vectors.united(vectors.united(np.arange(n), i[: m // 2], k[: m // 2]), i[m // 2 :], k[m // 2 :])
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(i, k):
                want[a] = want[b] = min(want[a], want[b])
        assert label.tolist() == want


def test_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    x = np.array(t["embedding"], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    top = list(range(len(x)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(x[i + 1 :] @ x[i] >= 0.9) + i + 1:
            a, b = sorted((find(i), find(j)))
            top[b] = a
    want = {(t["vec_id"][i], t["vec_id"][find(i)]) for i in range(len(x)) if find(i) != i}
    got = {(r.vec_id, r.kept_id) for r in vectors.near_groups(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) <= len(want) / 0.9


def test_table_distances_are_distances_to_decoded_codes():
    rng = np.random.default_rng(1)
    books = rng.normal(size=(8, 16, 8)).astype(np.float32)
    codes = rng.integers(0, 16, (30, 8)).astype(np.uint8)
    q = rng.normal(size=(5, 64)).astype(np.float32)
    want = ((q[:, None] - vectors.decode(codes, books)[None]) ** 2).sum(2)
    assert np.allclose(vectors.table_distances(q, codes, books), want, rtol=1e-3)


def test_edge_cases(spark):
    e = [1.0] + [0.0] * 63
    f = [0.999, 0.02] + [0.0] * 62
    g = [0.0, 1.0] + [0.0] * 62
    rows = [(1, None), (2, []), (3, [0.0] * 64), (4, [float("nan")] * 64), (5, e), (6, [2.0] + [0.0] * 63), (6, e), (7, f), (8, g), (None, e), (9, [1.0] * 63), (10, [None] + [1.0] * 63), (11, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).withColumn("a", F.lit("x"))
    assert sorted((r.vec_id, r.kept_id) for r in vectors.near_groups(df).collect()) == [(6, 5), (7, 5)]
    assert vectors.near_groups(df.where("false")).collect() == []
    assert vectors.near_groups(df.where("vec_id = 8")).collect() == []
