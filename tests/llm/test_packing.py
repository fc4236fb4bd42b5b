import numpy as np
from pyspark.sql import functions as F

from quern.llm import packing

L = (100, 5, 60)


def plain(demand, limits):
    """The heuristic, one item and one bin at a time."""
    limit = np.array(limits, float)
    weight = (demand / limit).sum(0)
    weight = weight / max(weight.sum(), 1e-12)
    todo, out, current = list(range(len(demand))), np.full(len(demand), -1), -1
    kinds = {tuple(x): i for i, x in enumerate(np.unique(demand, axis=0))}
    while todo:
        current += 1
        room = limit.copy()
        while fit := [i for i in todo if (demand[i] <= room).all()]:
            best = min(fit, key=lambda i: (-round(float((demand[i] / limit * weight) @ (room / limit)), 12), kinds[tuple(demand[i])], i))
            out[best] = current
            todo.remove(best)
            room -= demand[best]
    return out


def test_against_plain_loop():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 120):
        t = rng.integers(1, 60, n)
        demand = np.stack([t, np.ones(n, int), (t * rng.random(n)).astype(int)], 1)
        assert (packing.pack(demand, L) == plain(demand, L)).all()


def test_limits_hold_and_nothing_is_lost(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    examples = packing.examples_of_conversations(conv)
    want = {}
    for r in examples.collect():
        n, loss = want.get(r.example_id, (0, 0))
        want[r.example_id] = (n + sum(x.n for x in r.turns), loss + sum(x.n for x in r.turns if x.scored))
    limits = (1500, 4, 500)
    rows = packing.packed(examples, limits, 40).collect()
    bins, got = {}, {}
    for r in rows:
        b = bins.setdefault(r.bin_id, [0, 0, 0])
        for k, v in enumerate((r.n_tokens, 1, r.n_loss)):
            b[k] += v
        g = got.get(r.example_id, (0, 0))
        got[r.example_id] = (g[0] + r.n_tokens, g[1] + r.n_loss)
    assert all(x <= m for b in bins.values() for x, m in zip(b, limits))
    assert got == {k: v for k, v in want.items() if v[0]}
    assert len({(r.bin_id, r.slot) for r in rows}) == len(rows)
    need = max(sum(b[k] for b in bins.values()) / limits[k] for k in range(3))
    assert len(bins) < 1.35 * need + 5


def test_cut():
    assert packing.cut([], L) == []
    assert packing.cut([(0, True)], L) == []
    assert packing.cut([(100, False)], L) == [(100, 0)]
    assert packing.cut([(50, False), (61, True)], L) == [(100, 50), (11, 11)]
    assert packing.cut([(130, True)], L) == [(60, 60), (60, 60), (10, 10)]


def test_edge_cases(spark):
    rows = [(1, 0, "user", None), (2, 0, "assistant", ""), (3, 0, None, "hello there"), (3, 0, None, "hello there"), (None, 1, "assistant", "x"), (4, None, "assistant", "word " * 50000)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash")).withColumn("scored", F.lit(1))
    got = packing.packed(packing.examples_of_conversations(conv)).collect()
    total = {}
    for r in got:
        total[r.example_id] = total.get(r.example_id, 0) + r.n_tokens
    assert total == {3: 4, None: 1, 4: 50001}
    assert max(r.n_loss for r in got) == 2048
    assert packing.packed(packing.examples_of_conversations(conv.where("false"))).collect() == []
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (2, "d"), (2, "d")], "doc_id long, text string")
    assert sorted((r.example_id, r.n_tokens, r.n_loss) for r in packing.packed(packing.examples_of_documents(docs)).collect()) == [(1, 3, 3), (2, 1, 1), (2, 1, 1)]


def test_a_conversation_with_a_third_of_all_turns_is_spread(spark):
    rows = [(7, k, "assistant" if k % 2 else "user", "word " * (k % 5)) for k in range(10_000)]
    rows += [(100 + k % 5000, k // 5000, "user", "some words") for k in range(10_000)] + [(None, 0, "assistant", "word " * (k % 9)) for k in range(10_000)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = packing.examples_of_conversations(conv).cache()
    assert examples.where("example_id = 7").count() == 3
    assert max(len(r.turns) for r in examples.collect()) <= 4096
    limits = (40, 6, 25)
    got = packing.packed(examples, limits, 500).collect()
    hot = sorted((r for r in got if r.example_id == 7), key=lambda r: r.piece)
    assert [r.piece for r in hot] == list(range(len(hot)))
    want = []
    for r in sorted(examples.where("example_id = 7").collect(), key=lambda r: r.part):
        want += packing.cut([(x.n, x.scored) for x in r.turns], limits)
    assert [(r.n_tokens, r.n_loss) for r in hot] == want
    assert [r.start for r in hot] == [sum(n for n, _ in want[:k]) for k in range(len(want))]
    lone = [r for r in got if r.example_id is None]
    assert len({r.bin_id.split("-")[0] for r in lone}) > 1 and all(r.start == 0 and r.piece == 0 for r in lone)
    total = {r.example_id: sum(x.n for x in r.turns) for r in examples.where("example_id >= 100").collect()}
    assert {r.example_id: r.n_tokens for r in got if (r.example_id or 0) >= 100} == total


def test_sequences_hold_every_token_of_every_conversation(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    limits = (700, 4, 300)
    placed = packing.packed(packing.examples_of_conversations(conv), limits, 40)
    own = packing.tokens_of_conversations(conv)
    want = {r.example_id: (r.tokens, r.loss) for r in own.collect()}
    bins = {r.bin_id: r for r in packing.sequences(placed, own).collect()}
    for b in bins.values():
        assert len(b.tokens) == len(b.segments) == len(b.loss) <= limits[0] and sum(b.loss) <= limits[2] and len(set(b.segments)) <= limits[1]
    got = {}
    for r in placed.orderBy("example_id", "piece").collect():
        b = bins[r.bin_id]
        at = [k for k, s in enumerate(b.segments) if s == r.slot]
        t, m = got.setdefault(r.example_id, ([], []))
        assert len(t) == r.start and len(at) == r.n_tokens
        t += [b.tokens[k] for k in at]
        m += [b.loss[k] for k in at]
    assert got == {k: v for k, v in want.items() if v[0]}


def test_documents_are_packed_by_their_real_tokens(spark, sf_dir):
    import corpus_pipeline as cp
    from quern.llm.tokens import TOKENIZER, encode

    own = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select("doc_id", "text").limit(80)
    texts = {r.doc_id: r.text or "" for r in own.collect()} | {900001: "没有空格的文字" * 900, 900002: "Donaudampfschifffahrtsgesellschaft " * 400, 900003: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    real = {i: encode([t], TOKENIZER)[0] for i, t in texts.items()}
    rows = cp.pack(spark, docs, sf_dir).collect()
    at, bins = dict.fromkeys(real, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        held = real[r.doc_id][at[r.doc_id] : at[r.doc_id] + r.n_tokens]
        assert len(held) == r.n_tokens == r.n_loss
        at[r.doc_id] += r.n_tokens
        bins[r.bin_id] = bins.get(r.bin_id, 0) + len(held)
    assert at == {i: len(x) for i, x in real.items()}
    assert max(bins.values()) <= 2048 and len(bins) < 1.35 * max(sum(at.values()) / 2048, len(rows) / 16) + 5
