import json
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern import sources, streaming
from quern.functions import text as tx
from quern.functions import tokenize as tk
from quern.operators import messages as msg
from quern.plans.messages import log
from quern.sources import sinks


def test_message_log_with_lines_inside_fields(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text('Chat Session,Message Date,Type,Sender Name,Text\nc,2025-01-01 00:00:00,Incoming,A,"one\ntwo ""q"""\nc,2025-01-01 00:00:01,Outgoing,,x\n', encoding="utf-8")
    got = sources.message_log(spark, str(p)).orderBy("row_ord").collect()
    assert [r.Text for r in got] == ['one\ntwo "q"', "x"]


def test_text_json_and_instruction_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text('a "b"\t1\nplain\n')
    assert [r.text for r in sources.labelled_lines(spark, str(tmp_path / "t.txt")).orderBy("row_ord").collect()] == ['a "b"', "plain"]
    (tmp_path / "j.jsonl").write_text(json.dumps({"chat": "c", "text": "سلام"}, ensure_ascii=False) + "\n", encoding="utf-8")
    df = sources.json_lines(spark, str(tmp_path / "j.jsonl"), "chat string, text string", "text")
    assert df.columns == ["text"] and df.first().text == "سلام"
    m = spark.createDataFrame([([("user", "hi")], 1)], "messages array<struct<role:string,content:string>>, other int")
    m.write.parquet(str(tmp_path / "i"))
    assert sources.instructions(spark, str(tmp_path / "i")).columns == ["messages"]


def test_shards_and_nested_score(spark, tmp_path):
    rows = [("x " * 20, (1, (0.95,))), ("y", None)]
    spark.createDataFrame(rows, sources.WEB).repartition(2).write.parquet(str(tmp_path / "w"))
    df = sources.web_shards(spark, str(tmp_path / "w"), 1)
    assert df.select("shard").distinct().count() == 1
    assert "ReadSchema: struct<metadata" in df.select("metadata.labels.language_score")._jdf.queryExecution().toString()


def test_arrow_and_binary_streams(spark, tmp_path):
    t = pa.table({"text": ["a", "b", None], "z": [1, 2, 3]})
    with pa.ipc.new_file(str(tmp_path / "a.arrow"), t.schema) as w:
        w.write_table(t)
    with pa.ipc.new_stream(str(tmp_path / "b.arrow"), t.schema) as w:
        w.write_table(t)
    got = sources.arrow_files(spark, [str(tmp_path / n) for n in ("a.arrow", "b.arrow")], "text string")
    assert sorted(str(r.text) for r in got.collect()) == ["None", "None", "a", "a", "b", "b"]
    (tmp_path / "s.bin").write_bytes(struct.pack("<4H", 5, 40000, 7, 65535))
    (tmp_path / "m.bin").write_bytes(bytes([0, 1, 1, 0]))
    rows = sources.token_stream(spark, str(tmp_path / "s.bin"), str(tmp_path / "m.bin")).orderBy("pos").collect()
    assert [(r.token, r.scored) for r in rows] == [(5, False), (40000, True), (7, True), (65535, False)]
    (tmp_path / "m.bin").write_bytes(bytes([0, 1]))
    with pytest.raises(ValueError):
        sources.token_stream(spark, str(tmp_path / "s.bin"), str(tmp_path / "m.bin"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.arrow").rename(tmp_path / "sub/a.arrow")
    assert sorted(str(r.text) for r in sources.arrow_folder(spark, str(tmp_path), "text").collect()) == ["a", "a", "b", "b"]
    assert sources.arrow_folder(spark, str(tmp_path / "none"), "text").collect() == []


def test_binary_packs(spark, tmp_path):
    docs = spark.createDataFrame([(k, [(k * 7 + i) % 65536 for i in range(k % 5)], [i % 2 for i in range(k % 5)] if k % 3 else None) for k in range(300)], "d long, ids array<int>, mask array<int>").repartition(5)
    want = [(t, not k % 3 or i % 2 == 1) for k in range(300) for i, t in enumerate([(k * 7 + i) % 65536 for i in range(k % 5)])]
    counts = sinks.token_binary(docs, "d", "ids", str(tmp_path / "p"), "mask")
    assert counts == {"n_tokens": len(want), "n_scored": sum(m for _, m in want)}
    rows = sources.token_stream(spark, str(tmp_path / "p"), str(tmp_path / "p"), at_once=37).orderBy("pos").collect()
    assert [(r.pos, r.token, r.scored) for r in rows] == [(i, *x) for i, x in enumerate(want)]
    whole = b"".join(f.read_bytes() for f in sorted((tmp_path / "p").glob("*.bin")))
    assert whole == struct.pack(f"<{len(want)}H", *[t for t, _ in want])
    assert sinks.token_binary(docs, "d", "ids", (tmp_path / "q").as_uri())["n_scored"] == len(want)
    assert sinks.token_binary(docs.where("false"), "d", "ids", str(tmp_path / "e")) == {"n_tokens": 0, "n_scored": 0}
    bad = spark.createDataFrame([(1, [1, 2], [1])], "d long, ids array<int>, mask array<int>")
    with pytest.raises(Exception, match="a mask of 1 flags for 2 tokens"):
        sinks.token_binary(bad, "d", "ids", str(tmp_path / "b"), "mask")
    with pytest.raises(Exception, match="16 bits"):
        sinks.token_binary(spark.createDataFrame([(1, [70000])], "d long, ids array<int>"), "d", "ids", str(tmp_path / "b2"))


def test_texts_for_a_vocabulary(spark, tmp_path):
    (tmp_path / "log.csv").write_text('Chat Session,Message Date,Type,Sender Name,Text\nc,2025-01-01 00:00:00,Incoming,A," one "\nc,2025-01-01 00:00:01,Notification,,x\nc,2025-01-01 00:00:01,Outgoing,,\n')
    assert [r.text for r in sources.message_texts(spark, str(tmp_path / "log.csv")).collect()] == ["one"]
    assert sources.message_texts(spark, str(tmp_path / "none.csv")).collect() == []
    (tmp_path / "t.txt").write_text(" a \t1\n\t2\n\u00a0b\n")
    assert [r.text for r in sources.labelled_lines(spark, str(tmp_path / "t.txt"), stripped=True).orderBy("row_ord").collect()] == ["a", "b"]


def test_sources_by_name(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text("".join(json.dumps({"chat": "c", "text": f"t{i}"}) + "\n" for i in range(9)))
    own = sources.LOADERS["chat_holdout"]({"val": str(tmp_path / "h.jsonl")}, limit=3)
    assert [r.text for r in own.read(spark, "val").orderBy("row_ord").collect()] == ["t0", "t1", "t2"]
    with pytest.raises(KeyError):
        own.read(spark, "train")
    with pytest.raises(KeyError):
        sources.LOADERS["nothing"]
    sources.saved_cursor(spark, str(tmp_path / "cursor.json"), 40, 7)
    assert sources.read_cursor(spark, str(tmp_path / "cursor.json")) == (40, 7) and sources.read_cursor(spark, str(tmp_path / "no.json")) == (0, 67)


def test_meta_gate_and_registry(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps({"tokenizer_fingerprint": "abc"}))
    assert sources.checked_meta(spark, str(tmp_path / "meta.json"), "abc")
    with pytest.raises(ValueError):
        sources.checked_meta(spark, str(tmp_path / "meta.json"), "xyz")
    with pytest.raises(KeyError):
        sources.READERS["nothing"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", "x")], "chat string, text string")
    assert sinks.json_lines(df, str(tmp_path / "j"), ["chat"]) == 2
    s = spark.range(10).select(F.col("id").alias("pos"), F.lit(1).alias("token"), (F.col("id") < 3).alias("scored"))
    assert sinks.token_table(s, str(tmp_path / "t")) == {"n_tokens": 10, "n_scored": 3}
    sinks.splits(df.withColumn("split", F.lit("val")), str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=val").exists()
    m = spark.createDataFrame([(1, "loss", 2.0)], "step long, metric string, value double")
    sinks.append_metrics(m, str(tmp_path / "m"))
    sinks.append_metrics(m, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    sinks.append_samples(spark.createDataFrame([(1, "p", 0.5, "t")], "step long, prompt string, temperature double, text string"), str(tmp_path / "samples"))
    assert spark.read.parquet(str(tmp_path / "samples")).first().text == "t"
    sinks.meta(m, str(tmp_path / "meta"))


def test_tokenizer_round_trip_and_owner_mask(spark):
    text = "<s><|conv|><|turn|>Ann: hello you<|end|><|turn|>ME: fine thanks<|end|></s>"
    df = spark.createDataFrame([(1, text), (2, None)], "i int, t string")
    got = df.select("i", tk.decode(tk.encode(F.col("t"), marks=tk.MARKS), marks=tk.MARKS).alias("back")).orderBy("i").collect()
    assert got[0].back == text
    e = df.where("i = 1").select(tk.encode_with_offsets(F.col("t"), marks=tk.MARKS).alias("e"), tk.owner_spans(F.col("t")).alias("s"))
    r = e.select("e", tk.within(F.col("s"), F.col("e")).alias("m")).first()
    assert "".join(text[a:b] for a, b, m in zip(r.e.a, r.e.b, r.m) if m) == " fine thanks<|end|>"


def test_marks_are_single_tokens(tmp_path):
    ids = tk.mark_ids()
    assert len(set(ids.values())) == len(tk.MARKS) and min(ids.values()) >= 50257
    for mark, k in ids.items():
        assert tk.load(tk.TOKENIZER, tk.MARKS).encode(mark, add_special_tokens=False).ids == [k]
        assert len(tk.load(tk.TOKENIZER).encode(mark, add_special_tokens=False).ids) > 1
    tk.saved(tk.TOKENIZER, str(tmp_path / "t.json"))
    assert tk.load(str(tmp_path / "t.json")).encode("<|turn|>ME: x<|end|>", add_special_tokens=False).ids == tk.load(tk.TOKENIZER, tk.MARKS).encode("<|turn|>ME: x<|end|>", add_special_tokens=False).ids
    held = json.dumps({"added_tokens": [{"content": "<0x00>"}, {"content": "<s>"}], "model": {"vocab": {"<0x00>": 0}}})
    assert json.loads(tk.demoted(held, {"<0x00>"})) == {"added_tokens": [{"content": "<s>"}], "model": {"vocab": {"<0x00>": 0}}}


def test_answer_ids_are_those_in_context(spark):
    ids = tk.answer_ids(["A", "B", "C"], "\nAnswer:")
    load = tk.load(tk.TOKENIZER)
    assert [load.decode([i]) for i in ids] == [" A", " B", " C"]
    assert ids != [load.encode(x, add_special_tokens=False).ids[0] for x in "ABC"]
    with pytest.raises(ValueError):
        tk.answer_ids([""], "x", "/opt/tokenizers/word_bpe_49k.json")


def test_pieces_fall_back_to_bytes(spark):
    (r,) = spark.createDataFrame([("a \u5d1d \U0001f600", None)], "t string, u string").select(tk.encode_pieces(F.col("t")).alias("t"), tk.encode_pieces(F.col("u")).alias("u")).collect()
    assert tk._pieces(tk.PIECES).decode(r.t) == "a \u5d1d \U0001f600" and 0 not in r.t and r.u is None


def test_normal_form(spark):
    got = [r.t for r in spark.createDataFrame([("ﬁ…",), (None,)], "t string").select(tx.nfkc("t").alias("t")).collect()]
    assert got == ["fi...", None]


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_sessions_are_the_batch_sessions_that_are_over(spark, sf_dir, tmp_path):
    rows = log(spark, sf_dir).withColumn("chat", F.col("chat").cast("string")).withColumn("ts", F.col("ts").cast("timestamp"))
    end = rows.agg(F.max("ts")).first()[0]
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    got = {tuple(r) for r in run(spark, streaming.sessions(stream), "s", "append").collect()}
    batch = msg.sessions(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).groupBy("chat", "session_no").agg(F.min(F.col("ts").cast("timestamp")).alias("started"), F.max(F.col("ts").cast("timestamp")).alias("ended"), F.count("*").alias("n"))
    from datetime import timedelta

    want = {(r.chat, r.started, r.ended, r.n) for r in batch.collect() if r.ended + timedelta(hours=6) <= end}
    assert got == want and len(want) > 500


def test_stateful_streams(spark, tmp_path):
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate([3.0, 2.5, 2.7, 2.4, 2.9])], "run string, step long, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "v"))
    got = run(spark, streaming.improved(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "v"))), "i", "append")
    assert [r.improved for r in got.orderBy("step").collect()] == [True, True, False, True, False]
    turns = spark.createDataFrame([("c", i // 4, i % 4, n) for i, n in enumerate([900, 900, 900, 10, 20, 30])], "chat string, session_no long, turn_no long, n_chars long")
    turns.coalesce(1).write.parquet(str(tmp_path / "t"))
    got = run(spark, streaming.chunks(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "t"))), "c", "append")
    assert [r.chunk_no for r in got.orderBy("session_no", "turn_no").collect()] == [0, 0, 1, 1, 0, 0]
    listener = sinks.Progress(1)
    spark.streams.addListener(listener)
    few = spark.createDataFrame([(1,)], "i int")
    few.write.parquet(str(tmp_path / "f"))
    assert run(spark, streaming.files(spark, str(tmp_path / "f"), "i int"), "f", "append").count() == 1
    spark.streams.removeListener(listener)
    docs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "text string, s int").withColumn("ts", F.timestamp_seconds("s"))
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    got = run(spark, streaming.first_of_each(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "d")), "text", "ts", "1 hour"), "d", "append")
    assert sorted(r.text for r in got.collect()) == ["a", "b"]
