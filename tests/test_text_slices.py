"""Python workers make objects of a bounded part of an Arrow batch at a time, whatever the batch holds."""

import threading

import psutil
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import tokenize as tk

TEXTS = [None, "", "ab cd", "x " * tx.AT_ONCE, None, *["ﬁ some text 崝 "[: 3 + i % 12] * 400 for i in range(300)], "", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").coalesce(1)


def collected(df):
    return [r.x for r in df.orderBy("i").collect()]


def grown_mb(df):
    """MB that the Python worker of this table's one task grows by, at its peak."""
    first, most, over = {}, {}, threading.Event()

    def watch():
        while not over.wait(0.02):
            for p in psutil.Process().children(recursive=True):
                try:
                    if any("pyspark.daemon" in x for x in p.cmdline()):
                        mb = p.memory_info().rss / 1e6
                        most[p.pid] = max(most.get(p.pid, 0), mb - first.setdefault(p.pid, mb))
                except psutil.Error:
                    pass

    watching = threading.Thread(target=watch)
    watching.start()
    df.write.format("noop").mode("overwrite").save()
    over.set()
    watching.join()
    return max(most.values())


@pytest.fixture(scope="module")
def long_batch(spark):
    """10,000 texts of 2,000 characters in one task: one Arrow batch."""
    return spark.range(0, 10_000, 1, 1).select(F.repeat(F.lit("ab cd efg "), 200).alias("t"))


def test_slices_hold_every_value_once_and_no_more_than_a_part():
    batches = [pa.array(TEXTS, pa.string()), pa.array([], pa.string()), pa.array(TEXTS, pa.string()).slice(3, 40), pa.array([None, None], pa.string())]
    got = list(tx.slices(iter(batches)))
    assert [t for part in got for t in part] == TEXTS + TEXTS[3:43] + [None, None]
    assert all(len(list(filter(None, part))) == 1 or sum(len((t or "").encode()) for t in part) <= tx.AT_ONCE for part in got)
    lists = pa.array([[1, 2], None, [], [3] * (tx.AT_ONCE + 1), [4]], pa.list_(pa.int32()))
    assert [x for part in tx.slices(iter([lists])) for x in part] == lists.to_pylist()


def test_encoding_in_slices_gives_the_ids_of_whole_batches(texts):
    load = tk.load(tk.TOKENIZER, tk.MARKS)
    want = [None if t is None else load.encode(t, add_special_tokens=False).ids for t in TEXTS]
    coded = texts.select("i", tk.encode(F.col("t"), marks=tk.MARKS).alias("x"))
    assert collected(coded) == want
    assert collected(coded.select("i", tk.decode(F.col("x"), marks=tk.MARKS).alias("x"))) == [t or "" for t in TEXTS]


def test_encoding_takes_no_more_memory_for_a_full_batch(long_batch):
    assert grown_mb(long_batch.select(tk.encode(F.col("t")))) < 500


def test_pieces_in_slices_give_the_ids_of_whole_batches(texts):
    found = tk._pieces(tk.PIECES)
    assert collected(texts.select("i", tk.encode_pieces(F.col("t")).alias("x"))) == [None if t is None else found.encode(t) for t in TEXTS]


def test_pieces_take_no_more_memory_for_a_full_batch(long_batch):
    assert grown_mb(long_batch.select(tk.encode_pieces(F.col("t")))) < 300


def test_compression_encodes_each_text_once_and_leaves_null_texts_out(spark, tmp_path, capsys):
    rows = [("a", "ab cd"), ("a", None), ("a", ""), ("b", None), (None, "ﬁ 崝"), (None, "x" * 5000), ("c", "")]
    spark.createDataFrame(rows, "lang string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    from quern import plans

    q, found = plans.queries()["tok_piece_compression"](spark, str(tmp_path)), tk._pieces(tk.PIECES)
    q.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    want = {}
    for lang, text in rows:
        if text is not None:
            n, ids = want.get(lang, (0, 0))
            want[lang] = n + len(text), ids + len(found.encode(text))
    assert {r.lang: (r.n_chars, r.chars_per_token) for r in q.collect()} == {k: (n, n / max(ids, 1)) for k, (n, ids) in want.items()}


def test_normal_form_in_slices(texts):
    import unicodedata

    assert collected(texts.select("i", tx.nfkc("t").alias("x"))) == [t if t is None else unicodedata.normalize("NFKC", t) for t in TEXTS]


def test_normal_form_takes_no_more_memory_for_a_full_batch(spark):
    long = spark.range(0, 10_000, 1, 1).select(F.repeat(F.lit("ﬁ 崝 efg "), 700).alias("t"))
    assert grown_mb(long.select(tx.nfkc("t"))) < 300


def test_offsets_and_spans_in_slices_are_those_of_whole_batches(spark):
    load = tk.load(tk.TOKENIZER, tk.MARKS)
    said = [None, "", *[f"<s><|conv|><|turn|>Ann: 崝 hello {i}<|end|><|turn|>ME: {'fine ' * (i % 50)}\n<|end|></s>" * 20 for i in range(300)], ""]
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string").coalesce(1)
    got = df.select("i", tk.encode_with_offsets(F.col("t"), marks=tk.MARKS).alias("e"), tk.owner_spans(F.col("t")).alias("s")).orderBy("i").collect()
    assert len(got) == len(said)
    for r, t in zip(got, said):
        want = load.encode(t or "", add_special_tokens=False)
        assert (r.e.ids, list(zip(r.e.a, r.e.b))) == (want.ids, want.offsets)
        assert [(x.a, x.b) for x in r.s] == [(m.start(1), m.end(2)) for m in tk.OWNER_TURN.finditer(t or "")]


def test_offsets_take_no_more_memory_for_a_full_batch(long_batch):
    assert grown_mb(long_batch.select(tk.encode_with_offsets(F.col("t")))) < 500
