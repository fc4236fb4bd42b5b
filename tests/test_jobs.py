import json
import math

import pytest
from pyspark.sql import functions as F

from quern import cli, sources
from quern.functions import tokenize as tk
from quern.operators import blocks as bl
from quern.operators import evaluate as ev


def test_evaluators_are_scheduled_and_isolated(spark):
    scores = spark.createDataFrame([(1.0,), (3.0,)], "loss double")
    good = ev.Evaluator("loss", lambda d: d.agg(F.avg("loss").alias("mean"), F.count("*").alias("n")), 100, True)
    bad = ev.Evaluator("broken", lambda d: d.select("nothing"), 100, True)
    rare = ev.Evaluator("rare", lambda d: d.agg(F.max("loss").alias("max")), 0)
    got = ev.run_due([bad, good, rare], scores, 200)
    assert sorted(tuple(r) for r in got.collect()) == [(200, "loss/mean", 2.0), (200, "loss/n", 2.0)]
    assert ev.run_due([good], scores, 150) is None
    assert [s for s in range(1, 301) if good.due(s)] == [100, 200, 300] and good.due(0) and not rare.due(0)


def test_padding_is_ignored(spark):
    (r,) = spark.createDataFrame([([5, 0, 0],)], "l array<int>").select(ev.ignore_padding(F.col("l"), 0).alias("l")).collect()
    assert r.l == [5, -100, -100]


def test_message_job(spark, tmp_path):
    lines = ["Chat Session,Message Date,Type,Sender Name,Text"]
    for c in range(20):
        for k in range(6):
            lines.append(f"chat{c},2025-01-0{1 + k // 2} 0{k}:00:00,{'Outgoing' if k % 2 else 'Incoming'},{'' if k % 2 else 'Ann'},text {c} {k}")
    (tmp_path / "log.csv").write_text("\n".join(lines))
    counts = cli.messages(spark, str(tmp_path / "log.csv"), str(tmp_path / "out"), val_fraction=0.2)
    assert counts["train"] + counts["val"] == 60 and counts["val"] == 12
    train, val = (spark.read.json(str(tmp_path / f"out/{n}.jsonl")) for n in ("train", "val"))
    assert train.join(val, "chat", "left_semi").count() == 0
    assert train.where(~F.col("text").startswith("<s><|conv|><|turn|>")).count() == 0


def test_named_evaluators(spark):
    assert set(ev.EVALUATORS.known) == {"mmlu_letter", "mmlu_loglikelihood", "flores", "owner_reply", "chat_holdout", "generation"}
    made = ev.built_evaluators({"flores": {"freq": 100, "dialect": "x", "standard": "y"}, "generation": None})
    assert [(e.name, e.every, e.at_zero) for e in made] == [("flores", 100, True), ("generation", 500, True)]
    scores = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 1.0)], "side string, nll double")
    got = {r.metric: r.value for r in ev.run_due(made, scores, 100).collect()}
    assert abs(got["flores/gap"] - (math.exp(2) - math.exp(1))) < 1e-9
    assert ev.built_evaluators(None) == []
    with pytest.raises(KeyError):
        ev.built_evaluators({"nothing": {}})


TOKENIZER = tk.TOKENIZER


def test_pack_job(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("source").alias("shard"))
    out = str(tmp_path / "p")
    meta = cli.pack(spark, docs, out, TOKENIZER, 128, val_docs=20)
    assert json.loads((tmp_path / "p/meta.json").read_text())["splits"] == meta["splits"]
    assert meta["n_blocks"] == (meta["splits"]["train"] - 1) // 128 > 50 and meta["documents_kept"] + meta["documents_dropped"] == docs.count()
    load = tk.load(TOKENIZER, tk.MARKS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = spark.read.parquet(f"{out}/ids").orderBy("ord").collect()
    val = [r for r in ids if r.split == "val"]
    assert 0 < len(val) < len(ids) == meta["documents_kept"]
    for name in ("train", "val"):
        want = [t for r in ids if r.split == name for t in load.encode(texts[r.ord], add_special_tokens=False).ids + [meta["eos_id"]]]
        rows = sources.token_stream(spark, f"{out}/{name}", at_once=1000).orderBy("pos").collect()
        assert [r.pos for r in rows] == list(range(meta["splits"][name])) and [r.token for r in rows] == want


def chat_lines(path, chats, own, n=6):
    """Conversations in which the owner says a share of the turns."""
    rows = []
    for c in chats:
        for k in range(n):
            turns = "".join(f"<|turn|>{'ME' if i < own else 'Ann'}: some words {c} {k} {i}<|end|>" for i in range(5))
            rows.append(json.dumps({"chat": c, "text": f"<s><|conv|>{turns}</s>"}))
    path.write_text("\n".join(rows) + "\n")
    return [json.loads(r)["text"] for r in rows]


def test_stage_jobs(spark, sf_dir, tmp_path):
    load = tk.load(TOKENIZER, tk.MARKS)
    coded = lambda t: load.encode(t, add_special_tokens=False).ids + [load.token_to_id("</s>")]
    low = chat_lines(tmp_path / "low.jsonl", ["a", "b"], 0)
    high = chat_lines(tmp_path / "high.jsonl", ["c", "d"], 3)
    (tmp_path / "train.jsonl").write_text((tmp_path / "low.jsonl").read_text() + (tmp_path / "high.jsonl").read_text())
    val = chat_lines(tmp_path / "val.jsonl", ["e"], 1, 2)
    (tmp_path / "small.jsonl").write_text("".join(json.dumps({"text": f"small text {i}"}) + "\n" for i in range(4)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cli.pack(spark, docs, str(tmp_path / "pre"), TOKENIZER, 128, val_docs=5)
    pre = [r.token for r in sources.token_stream(spark, str(tmp_path / "pre/train")).orderBy("pos").collect()]

    at = lambda name: str(tmp_path / name)
    meta = cli.stage_c(spark, at("train.jsonl"), at("small.jsonl"), at("pre"), at("c"), TOKENIZER, at("val.jsonl"), upsample=2)
    got = [r.token for r in sources.token_stream(spark, at("c/train")).orderBy("pos").collect()]
    primary = [t for x in low for t in coded(x)] + [t for i in range(4) for t in coded(f"small text {i}")] * 2
    n = int(len(primary) * 0.25 / 0.75)
    start = bl.slice_start(len(pre), n)
    assert got == primary + pre[start : start + n] and meta["replay_tokens"] == n and meta["primary_tokens"] == len(primary)
    assert [r.token for r in sources.token_stream(spark, at("c/val")).orderBy("pos").collect()] == [t for x in val for t in coded(x)]
    assert [r.chat for r in spark.read.json(at("c/chats_used")).orderBy("chat").collect()] == ["a", "b"] and meta["replay_fraction_actual"] == round(n / len(got), 4)

    meta = cli.stage_d(spark, at("train.jsonl"), at("val.jsonl"), at("d"), TOKENIZER)
    rows = sources.token_stream(spark, at("d/train"), at("d/train")).orderBy("pos").collect()
    assert [r.token for r in rows] == [t for x in high for t in coded(x)]
    want = [m for x in high for m in plain_mask(load, x) + [0]]
    assert [int(r.scored) for r in rows] == want and meta["scored_tokens"]["train"] == sum(want) and meta["scored_fraction"] == round(sum(want) / len(want), 4)


def plain_mask(load, text):
    """Flags of the tokens between each of the owner's labels and the end of its closing mark, found without a pattern."""
    encoding, spans, at = load.encode(text, add_special_tokens=False), [], 0
    while (at := text.find("<|turn|>ME:", at)) >= 0:
        start, end = at + len("<|turn|>ME:"), text.find("<|end|>", at)
        if end < 0:
            break
        spans.append((start, end + len("<|end|>")))
        at = end
    return [int(a < b and any(a >= s and b <= e for s, e in spans)) for a, b in encoding.offsets]


def test_owner_mask_query_against_a_plain_version(spark, sf_dir):
    from quern import plans

    load = tk.load(TOKENIZER, tk.MARKS)
    rows = plans.queries()["tok_owner_mask"](spark, sf_dir).collect()
    scored = 0
    for r in rows:
        text = load.decode(r.ids, skip_special_tokens=False)
        assert load.encode(text, add_special_tokens=False).ids == r.ids
        assert r.mask == plain_mask(load, text)
        scored += sum(r.mask)
    assert len(rows) > 100 and scored > 100


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"block": 256, "out": "from file"}))
    s = cli.settings(["--config", str(tmp_path / "c.json"), "pack", "--out", "given"])
    assert s.block == 256 and s.out == "given" and cli.given(s, "block", "val_docs") == {"block": 256}
    s = cli.settings(["messages", "--val-fraction", "0"])
    assert cli.given(s, "val_fraction") == {"val_fraction": 0.0}
