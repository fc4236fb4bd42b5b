from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import instructions as ins
from quern.operators import messages as msg

BASE = datetime(2025, 1, 1, 12)


def log(spark, rows):
    return spark.createDataFrame([(c, BASE + timedelta(seconds=s), w, t, i) for i, (c, s, w, t) in enumerate(rows)], "chat string, ts timestamp_ntz, speaker string, text string, row_ord long")


def test_sessions_split_only_beyond_the_gap(spark):
    def n(*minutes):
        return msg.sessions(log(spark, [("c", m * 60, "a", "x") for m in minutes])).agg(F.max("session_no")).first()[0] + 1

    assert (n(0, 5, 420), n(0, 300), n(0, 360), n(0, 361)) == (2, 1, 1, 2)


def test_runs_merge_neighbours_of_one_speaker(spark):
    rows = [("c", 0, "A", "one"), ("c", 0, "A", "two"), ("c", 1, "B", "reply"), ("c", 2, "A", "three")]
    got = msg.runs(msg.sessions(log(spark, rows))).orderBy("run_no").collect()
    assert [(r.speaker, r.text) for r in got] == [("A", "one two"), ("B", "reply"), ("A", "three")]


def merged(spark, sizes):
    return spark.createDataFrame([("c", 0, i, f"s{i % 2}", "x" * n) for i, n in enumerate(sizes)], "chat string, session_no long, run_no long, speaker string, text string")


def test_chunks(spark):
    def of(sizes, **kw):
        return [r.chunk_no for r in msg.chunks(merged(spark, sizes), min_turns=1, **kw).orderBy("run_no").collect()]

    assert of([900, 900, 900, 10]) == [0, 0, 1, 1]
    assert of([3000, 5, 5]) == [0, 1, 1]
    assert max(of([1] * 80).count(k) for k in range(3)) == 30
    assert msg.chunks(merged(spark, [5])).count() == 0


def plain(rows, gap=6 * 3600, turns=4, chars=12):
    """Sessions, runs and chunks one message at a time."""
    out = []
    by = {}
    for i, (c, s, w, t) in enumerate(rows):
        by.setdefault(c, []).append((s, i, w, t))
    for c, own in by.items():
        own.sort()
        session, last, merged_, before = 0, None, [], None
        for s, _, w, t in own:
            if before is not None and s - before > gap:
                session, last = session + 1, None
            before = s
            if last == w:
                merged_[-1][2] += " " + t
            else:
                merged_.append([session, w, t])
            last = w
        chunk, size, n, now = 0, 0, 0, None
        for session, w, t in merged_:
            if session != now:
                chunk, size, n, now = 0, 0, 0, session
            elif size and (size >= turns or n + len(t) > chars):
                chunk, size, n = chunk + 1, 0, 0
            size, n = size + 1, n + len(t)
            out.append((c, session, w, t, chunk))
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("cd"), st.integers(0, 200000), st.sampled_from("ABC"), st.text("xyz", min_size=1, max_size=9)), min_size=1, max_size=40))
def test_whole_chain_against_a_plain_loop(spark, rows):
    got = msg.chunks(msg.runs(msg.sessions(log(spark, rows))), 4, 12, 1)
    assert sorted((r.chat, r.session_no, r.speaker, r.text, r.chunk_no) for r in got.collect()) == plain(rows)


def test_hold_out_takes_whole_chats_in_order(spark):
    def held(sizes, fraction):
        df = spark.createDataFrame([(f"chat{i}", n) for i, n in enumerate(sizes)], "chat string, n long")
        return {r.chat: r.n for r in msg.hold_out(df, fraction).where("held").collect()}

    a = held([10] * 40, 0.2)
    assert sum(a.values()) == 80 and a == held([10] * 40, 0.2)
    b = held([10] * 100, 0.1)
    assert 0.08 < sum(b.values()) / 1000 < 0.2
    sizes = [10, 100, 10, 10, 10]
    c = held(sizes, 25 / sum(sizes))
    assert sum(c.values()) in (30, 100, 110, 120)


def test_typed_messages(spark):
    rows = [
        ("c", "2025-01-01 12:00:00", "Outgoing", "", "hi\n  there"),
        ("c", "2025-1-2 3:4:5", "Incoming", " Ann ", "a  b"),
        ("c", "2025-01-01 12:00:00", "Incoming", None, "call +249 912 345 678 now"),
        ("", "2025-01-01 12:00:00", "Incoming", None, "x"),
        ("c", "2025-01-01 12:00:00", "Notification", None, "joined"),
        ("c", "not a date", "Incoming", "B", "x"),
        ("c", "2025-01-01 12:00:00", "Incoming", "B", " \n "),
    ]
    raw = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "`Chat Session` string, `Message Date` string, Type string, `Sender Name` string, Text string, row_ord long")
    got = [(r.speaker, r.text) for r in msg.typed_messages(raw, True).orderBy("row_ord").collect()]
    assert got == [("ME", "hi there"), ("Ann", "a b"), ("c", "call <phone> now"), ("UNKNOWN", "x")]


def test_document_cleaning(spark):
    rows = ["﻿ see https://a.b/c?d and @كاتب end…", "keep… ", "a\r\nb", "فى", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r.t for r in df.select("i", tx.clean_document(F.col("t"), True).alias("t")).orderBy("i").collect()]
    assert got == ["see and end", "keep", "a b", "في", None, ""]


def test_loss_mask_counts_the_reply_and_its_end_mark(spark):
    conv = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "one two"), (1, 2, "assistant", "<think>a\nb</think> x y"), (2, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    (r,) = ins.masked_tokens(ins.usable_turns(conv)).collect()
    assert r.tokens == ["<s>", "<|conv|>", "<|turn|>", "USER:", "one", "two", "<|end|>", "<|turn|>", "ASSISTANT:", "x", "y", "<|end|>", "</s>"]
    assert r.mask == [0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 0]
