import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import textbytes as tb
from quern.llm import toxicity


def made(n, words, share, seed):
    rng = np.random.default_rng(seed)
    base = [f"{a}{b}ing" for a in ("mar", "tol", "ven", "sor", "kil", "dan") for b in ("a", "e", "ost", "ir", "un")]
    return [" ".join(rng.choice(words) if rng.random() < share else rng.choice(base) for _ in range(rng.integers(40, 200))) for _ in range(n)]


def tables(spark, n=120):
    bad = ["vilebag", "Stinker", "mudface", "rotbrain"]
    rows = [(i, t, 1) for i, t in enumerate(made(n, bad, 0.05, 1))] + [(n + i, t, 0) for i, t in enumerate(made(3 * n, ["plainly"], 0.05, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad int")
    labels = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("quality"), F.col("bad").alias("toxic"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(docs, "doc_id").where("doc_id % 2 = 1").select("toxic", "bad").collect()
    assert sum(r.toxic and r.bad for r in got) >= 0.95 * sum(r.bad for r in got)
    assert sum(r.toxic and not r.bad for r in got) <= 0.03 * sum(not r.bad for r in got)


def test_real_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.where("doc_id % 3 > 0")
    flags = {r.doc_id: r.toxic for r in toxicity.score(docs, toxicity.train(docs, train)).select("doc_id", "toxic").collect()}
    held = [(flags[r.doc_id], r.toxic) for r in labels.where("doc_id % 3 = 0").collect()]
    # About one label in twenty says toxic of a document without any toxic word.
    assert sum(f for f, t in held if t) >= 0.85 * sum(t for _, t in held)
    assert sum(f for f, t in held if not t) <= 0.02 * sum(not t for _, t in held)


def test_windows_hold_every_word_and_scores_agree_with_a_loop():
    for n in (0, 1, 11, 12, 13, 21, 22, 400):
        text = " ".join(f"w{i}" for i in range(n))
        found = [w for _, w in toxicity._text_windows(pa.array([text]))][0]
        symbols = {x[i : i + toxicity.WIDTH] for x in found for i in range(0, len(x), toxicity.WIDTH)}
        assert len(symbols) == n
    gain = np.random.default_rng(0).integers(-1, 15, 90)
    want = max(gain[i : i + toxicity.BLOCK].mean() for i in range(len(gain) - toxicity.BLOCK + 1))
    assert np.allclose(toxicity.scores(gain), (gain.mean(), want))


def parts(text):
    (w,) = tb.words(pa.array([text]))
    return [tuple(x[k : k + 1].tobytes() for k in range(3)) for x in toxicity.symbols(w)[0]]


def test_symbols_have_two_beginnings_and_the_whole_word():
    a, b, c, d, e, f = parts("(Worthless), worthlessly WORTHL worthless!!!!!!! worth ?")
    assert a == d and a[:2] == b[:2] == c[:2] and len({a[2], b[2], c[2]}) == 3
    assert e[0] == a[0] and e[1] != a[1]
    x, y = parts("internal internet")
    assert x[:2] == y[:2] and x[2] != y[2]
    x, y = parts("\u0645\u062f\u0631\u0633\u0629 \u0645\u062f\u0631\u0633")
    assert x[0] == y[0] and x[1] != y[1] and x[2] != y[2]
    assert parts("!!! bad!!!!!")[1:] == parts("bad") and len(parts("!!!")) == 1


def test_edge_cases(spark):
    docs, labels = tables(spark, 60)
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(None, "vilebag mudface " * 30), (1, None), (2, ""), (3, "\n\t "), (4, "plain " * 200000), (5, "rotbrain stinker vilebag"), (5, "rotbrain stinker vilebag")], "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("gain", F.lit(1))
    got = sorted(((str(r.doc_id), r.toxic) for r in toxicity.score(odd, model).collect()))
    assert got == [("1", False), ("2", False), ("3", False), ("4", False), ("5", True), ("5", True), ("None", True)]
    assert toxicity.score(odd.where("false"), model).collect() == []
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.train(docs, labels.where("false")) is None
    assert toxicity.toxic_documents(odd, labels.where("false")).collect() == []


def test_every_character_of_text_without_blanks_is_in_a_symbol():
    run = "".join(chr(0x4E00 + 7 * i) for i in range(600))
    long = "a\u00a0" * 40 + "end"
    assert [len(parts(t)) for t in (run, long, "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35", "\u0441\u043b\u043e\u0432\u0430\u0440\u044c", "worthless")] == [300, 14, 3, 1, 1]
    for text in (run, long, "internationalisation", "\u0441\u043b\u043e\u0432\u0430\u0440\u044c"):
        for i in range(0, len(text), 7):
            other = text[:i] + "z" + text[i + 1 :]
            assert sum(x != y for x, y in zip(parts(text), parts(other))) == 1


def test_dictionaries_grow_with_their_samples():
    few, many = ([f"{i:024d}".encode() for i in range(n)] for n in (50, 100_000))
    assert toxicity._sizes(few)[-1] <= 4 * toxicity._room(few) + 256
    assert toxicity._sizes(many) == [int(toxicity._room(many) * s) for s in toxicity.SHARES]
    assert toxicity._dictionary(few[:2], 300) == b"".join(few[:2])
