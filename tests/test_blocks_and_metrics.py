import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import blocks as bl
from quern.operators import corpus
from quern.operators import evaluate as ev
from quern.operators import messages as msg
from quern.operators import metrics as mt


def docs_of(spark, n, longest=300, seed=0, mask=False):
    """Documents of many lengths, some empty, whose tokens are the positions of their stream."""
    rng = random.Random(seed)
    rows, at, k = [], 0, 0
    while at < n:
        size = min(n - at, rng.choice([0, 1, 2, rng.randrange(longest)]))
        rows.append((3 * k, list(range(at, at + size)), [int(x % 3 == 0) for x in range(at, at + size)]))
        at, k = at + size, k + 1
    return spark.createDataFrame(rows, "d long, ids array<int>, mask array<int>").repartition(3)


def test_blocks_shift_cover_and_drop_the_tail(spark):
    for n, size in ((5000, 128), (64 * 20 + 1, 64), (64 * 20, 64), (700, 1), (90, 89), (90, 90)):
        got = sorted(bl.blocks(docs_of(spark, n, seed=n), "d", "ids", size).collect())
        assert [r.block_id for r in got] == list(range((n - 1) // size))
        for r in got:
            assert r.inputs == list(range(r.block_id * size, r.block_id * size + size)) and r.labels == [x + 1 for x in r.inputs]
    assert bl.count_blocks(5000, 128) == 39
    assert bl.blocks(docs_of(spark, 5).where("false"), "d", "ids", 4).collect() == []
    with pytest.raises(ValueError):
        bl.count_blocks(10, 1024)


def test_mask_of_a_label_is_that_of_the_next_token(spark):
    got = sorted(bl.blocks(docs_of(spark, 9, 4), "d", "ids", 4, "mask").collect())
    assert got[0].labels == [-100, -100, 3, -100] and got[1].labels == [-100, 6, -100, -100]


def test_labels_slices_and_streams(spark):
    docs = docs_of(spark, 400, 30)
    assert sorted(tuple(r) for r in bl.shifted_labels(docs, "d", "ids").collect()) == [(i, i, i + 1) for i in range(399)]
    assert sorted(tuple(r) for r in bl.stream(docs, "d", "ids").collect()) == [(i, i) for i in range(400)]
    for start, n in ((0, 400), (37, 120), (399, 5), (500, 3), (10, 0)):
        parts = sorted((r.pos, r.tokens) for r in bl.contiguous_slice(docs, "d", "ids", start, n).collect())
        assert [t for _, x in parts for t in x] == list(range(400))[start : start + n] and all(p == x[0] for p, x in parts)
    starts = [bl.slice_start(1000, 100, s) for s in range(300)]
    assert min(starts) >= 0 and max(starts) < 899 and len(set(starts)) > 200 and bl.slice_start(50, 100) == 0


def test_ranks_of_a_hash_order(spark):
    rows = spark.range(500).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 3).alias("g"))
    for digits in (1, 2):
        got = {r.id: r["rank"] for r in bl.ranked(rows, "h", "id", digits=digits).collect()}
        assert got == {r.id: k for k, r in enumerate(rows.orderBy("h", "id").collect())}
    by = bl.ranked(rows, "h", "id", ["g"]).collect()
    for g in range(3):
        assert [r["rank"] for r in sorted((r for r in by if r.g == g), key=lambda r: r.h)] == list(range(sum(r.g == g for r in by)))


def walked(steps, n, each, position=0):
    """The cursor step by step, and the places of each step."""
    out = []
    for _ in range(steps):
        if position % n + each > n:
            position = (position // n + 1) * n
        out.append((position // n, position % n))
        position += each
    return position, out


def test_cursor_and_resume_after_a_change_of_ranks(spark):
    rng = random.Random(3)
    for _ in range(400):
        n, each, position = rng.randrange(5, 40), rng.randrange(1, 6), rng.randrange(100)
        steps = rng.randrange(60)
        assert bl.cursor_after(steps, n, each, position) == walked(steps, n, each, position)[0]
    order = bl.epoch_order(spark.range(20).select(F.col("id").alias("block_id")), F.sequence(F.lit(0), F.lit(3)))
    place = {(r.epoch, r.block_id): r.place for r in order.collect()}
    at = bl.cursor_after(3, 20, 4)
    rows = bl.assignments(order, 20, 2, 3, position=at).collect()
    _, want = walked(max(r.step for r in rows) + 1, 20, 6, at)
    for k, (epoch, offset) in enumerate(want):
        own = sorted((r.slot * 3 + r["rank"], place[r.epoch, r.block_id]) for r in rows if r.step == k)
        assert {r.epoch for r in rows if r.step == k} == {epoch} and own == [(i, offset + i) for i in range(6)]


def test_offsets_in_two_steps(spark):
    docs = spark.createDataFrame([(i * 3, i % 5) for i in range(200)], "d long, n long")
    got = {r.d: r.start for r in bl.offsets(docs, "d", "n", 7).collect()}
    total, want = 0, {}
    for i in range(200):
        want[i * 3] = total
        total += i % 5
    assert got == want
    assert bl.offsets(docs.where("false"), "d", "n").collect() == []


def test_assignments_resume_where_they_stopped(spark):
    ids = spark.range(20).select(F.col("id").alias("block_id"))
    order = bl.epoch_order(ids, F.sequence(F.lit(0), F.lit(2)))
    rows = bl.assignments(order, 20, 3, 2).collect()
    assert {r.step for r in rows} == set(range(9)) and all(sum(x.step == k for x in rows) == 6 for k in range(9))
    assert set(rows) - set(bl.assignments(order, 20, 3, 2, 5).collect()) == {r for r in rows if r.step < 5}
    for e in range(3):
        own = [r.block_id for r in rows if r.epoch == e]
        assert len(own) == len(set(own)) == 18
    with pytest.raises(ValueError):
        bl.assignments(order, 20, 30, 2)


def test_replay_takes_whole_batches(spark):
    docs = spark.range(1000).select(F.col("id").alias("d"), F.lit(10).alias("n"))
    got = bl.replay(docs, "d", "n", 1500)
    assert got.count() == 192 and {r.batch_no for r in got.collect()} == {0, 1, 2}


def test_splits(spark):
    docs = spark.range(1003).select(F.col("id").alias("d"), (F.col("id") % 4).alias("g"))
    assert corpus.exact_split(docs, "d", 0.1).where("split = 'test'").count() == 101
    assert corpus.exact_sample(docs, "d", 0.1).count() == 100
    assert corpus.exact_split(docs, "d", 0.0).where("split = 'test'").count() == 0 == corpus.exact_split(docs.where("false"), "d", 0.1).count()
    assert corpus.at_most_per_group(docs, "g", "d", 5).count() == 20
    share = docs.where(corpus.sampled(F.col("d"), 0.5)).count() / 1003
    assert 0.4 < share < 0.6
    halves = corpus.places(corpus.exact_split(docs, "d", 0.5, rounding=F.floor), "d").collect()
    for name, n in (("test", 501), ("train", 502)):
        assert [r.place for r in sorted((r for r in halves if r.split == name), key=lambda r: r.d)] == list(range(1, n + 1))


def test_validation_quota_comes_from_all_over_each_group(spark):
    docs = spark.range(40_000).select(F.col("id").alias("d"), F.when(F.col("id") % 4 < 3, F.col("id") % 4).alias("g"))
    keep = corpus.sampled(F.col("d"), 0.5)
    got = corpus.validation_quota(docs, "g", "d", keep, 400, 4).collect()
    assert {r.d for r in got} == {r.d for r in docs.where(keep).collect()}
    for g in (0, 1, 2, None):
        val = sorted(r.d for r in got if r.g == g and r.split == "val")
        assert 70 <= len(val) <= 100 and val[-1] > 30_000 and abs(val[len(val) // 2] - 20_000) < 6_000
    # More groups than the quota: one a group at most, not none.
    few = corpus.validation_quota(docs.withColumn("g", F.col("d") % 50), "g", "d", keep, 10, 50).where("split = 'val'").groupBy("g").count().collect()
    assert len(few) > 20 and all(r["count"] == 1 for r in few)


def test_perplexity_weighs_tokens_and_has_a_cap(spark):
    rows = [("u", math.log(50))] * 7 + [("long", 1.0)] * 9 + [("long", 3.0)] + [("cap", 90.0)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, nll double").groupBy("k").agg(mt.perplexity(F.sum("nll"), F.count("nll")).alias("p"))
    got = {r.k: r.p for r in df.collect()}
    assert abs(got["u"] - 50) < 1e-9 and abs(got["long"] - math.exp(1.2)) < 1e-9 and abs(got["cap"] - math.exp(20)) < 1e-3 and got["none"] == 1


def test_series_and_schedule(spark):
    s = spark.createDataFrame(list(enumerate([3.0, 2.5, 2.7, 2.4, 2.9])), "step long, v double")
    assert [r.improved for r in mt.improved(s, "step", "v").orderBy("step").collect()] == [True, True, False, True, False]
    lr = [r[0] for r in spark.range(1100).select(mt.learning_rate(F.col("id"), 1000, 1.0, 100)).collect()]
    assert abs(lr[99] - 1) < 1e-12 and all(abs(x - 0.1) < 1e-9 for x in lr[1000:])
    assert [r[0] for r in spark.range(1, 301).where(mt.due(F.col("id"), 100, True)).collect()] == [100, 200, 300]


def test_truncation_and_argmax(spark):
    x = spark.createDataFrame([(1, p, v) for p, v in enumerate([0.5, 0.2, 0.2, 0.1])], "g int, pos int, v double")
    assert mt.top_k(x, "g", "v", 2).count() == 3
    assert sorted(r.pos for r in mt.top_p(x, "g", "v", "pos", 0.6).collect()) == [0, 1]
    row = spark.createDataFrame([([1.0, 3.0, 3.0],)], "l array<double>").select(mt.argmax(F.col("l")).alias("a"), mt.log_softmax(F.col("l")).alias("s")).first()
    assert row.a == 1 and abs(sum(map(math.exp, row.s)) - 1) < 1e-12
    n = spark.range(2000).select(mt.gumbel_draw(F.array(F.lit(math.log(0.8)), F.lit(math.log(0.2))), F.col("id")).alias("t")).where("t = 0").count()
    assert 1500 < n < 1700


def test_accuracy_against_chance(spark):
    letters = spark.createDataFrame([([0.0, 5.0, 1.0, 9.0], 0, 2), ([0.0, 1.0, 2.0, 9.0], 1, 3), ([3.0, 1.0, 2.0, 9.0], 3, 4)], "logits array<double>, gold long, n_options int")
    r = ev.letter_accuracy(letters, [1, 2, 0, 3]).first()
    assert r.letter_acc == 1 and abs(r.chance - (1 / 2 + 1 / 3 + 1 / 4) / 3) < 1e-12 and abs(r.letter_pred_frac_0 - 1 / 3) < 1e-12
    options = spark.createDataFrame([(1, 0, 1, -2.0), (1, 0, 1, -2.0), (1, 1, 1, -1.0), (2, 0, 0, -1.0), (2, 1, 0, -1.0), (2, 2, 0, -3.0), (2, 3, 0, -9.0)], "idx int, option_ord int, gold int, logp double")
    r = ev.option_accuracy(options).first()
    assert (r.acc, r.chance) == (1.0, 0.375)
    assert ev.option_accuracy(options.where("false")).first().acc == 0


def test_scored_places(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [1, 1, 0]), ([5.0], [1]), ([1.0, 7.0], [0, 0]), ([4.0, 4.0], [0, 1])], "nll array<double>, mask array<int>")
    assert [r.s for r in rows.select(ev.both_real(F.col("nll"), F.col("mask")).alias("s")).collect()] == [[2.0], [], [], [4.0]]
    r = ev.reply_perplexity(rows).first()
    assert r.tokens == 2 and abs(r.ppl - math.exp(3)) < 1e-9


def test_shares_and_pools(spark):
    masks = spark.createDataFrame([("a", [0, 1, 1, 0]), ("a", [0, 0]), ("b", [0] * 9 + [1])], "chat string, mask array<int>")
    shares = msg.share_of_masks(masks, "mask")
    assert {r.chat: (r.n_tokens, r.n_owner, r.pool) for r in shares.collect()} == {"a": (6, 2, "high"), "b": (10, 1, "low")}
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "chat string, i int")
    assert sorted((r.i, r.pool) for r in msg.pools(rows, shares).collect()) == [(1, "high"), (2, "low"), (3, "high")]
