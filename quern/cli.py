"""Jobs: python -m quern.cli {messages,pack,stage-c,stage-d,query} ... A JSON file gives settings; options on the command line win."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans, sources
from .functions import tokenize as tk
from .operators import blocks as bl
from .operators import corpus
from .operators import messages as msg
from .sources import sinks

SEED, END = 67, "</s>"


def messages(spark: SparkSession, path: str, out: str, pseudonymize: bool = False, val_fraction: float = 0.03, seed: int = SEED) -> dict:
    """A CSV log to conversations, with whole chats held out: train.jsonl, val.jsonl and the list of held chats under out."""
    rows = msg.typed_messages(sources.message_log(spark, path), pseudonymize)
    made = msg.conversations(msg.chunks(msg.runs(msg.sessions(rows)))).select("chat", "session_no", "chunk_no", "text")
    made.write.parquet(f"{out}/conversations")
    made = spark.read.parquet(f"{out}/conversations")
    held = msg.hold_out(made.groupBy("chat").agg(F.count("*").alias("n")), val_fraction, seed).where("held").select("chat")
    counts = {}
    for name, how in (("train", "left_anti"), ("val", "left_semi")):
        counts[name] = sinks.json_lines(made.join(held, "chat", how), f"{out}/{name}.jsonl", ["chat", "session_no", "chunk_no"])
    sinks.meta(held.agg(F.array_sort(F.collect_set("chat")).alias("chats")), f"{out}/held_chats.json")
    return counts


def _encoded(text: Column, tokenizer: str) -> Column:
    """A text's ids and the end mark behind them."""
    return F.concat(tk.encode(text, tokenizer, tk.MARKS), F.array(F.lit(tk.mark_ids(tokenizer)[END])))


def _vocabulary(tokenizer: str) -> dict:
    return {"dtype": "uint16", "vocab_size": tk.load(tokenizer, tk.MARKS).get_vocab_size(), "tokenizer_fingerprint": sources.fingerprint(tokenizer), "eos_id": tk.mark_ids(tokenizer)[END], "seed": SEED}


def _saved_meta(spark: SparkSession, out: str, meta: dict, began: float) -> dict:
    meta = {**meta, "built_seconds": round(time.time() - began, 1)}
    sources.write_text(spark, f"{out}/meta.json", json.dumps(meta, indent=2))
    return meta


def _written(spark: SparkSession, ids: DataFrame, out: str, name: str, mask: str | None = None) -> dict:
    """A split's table (ord, ids[, mask]) as 16-bit files under out/name; encoding is done once, as its table is read for the ranges and for the tokens."""
    ids.write.parquet(f"{out}/ids/{name}")
    return sinks.token_binary(spark.read.parquet(f"{out}/ids/{name}"), "ord", "ids", f"{out}/{name}", mask)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ord, which grows with the order of all rows."""
    return rows.orderBy(*order).withColumn("ord", F.monotonically_increasing_id())


def pack(spark: SparkSession, docs: DataFrame, out: str, tokenizer: str, block: int = 1024, keep: float = corpus.KEEP, val_docs: int = 10_000) -> dict:
    """Documents (doc_id, text[, score][, shard]) to token files of the splits train and val and their metadata under out: those that are drawn and pass the filters, of which every shard gives its share to val."""
    began = time.time()
    docs = docs.withColumn("shard", F.col("shard").cast("string") if "shard" in docs.columns else F.lit(""))
    good = corpus.sampled(F.col("doc_id"), keep, SEED) & corpus.valid_text(F.col("text"))
    if "score" in docs.columns:
        good = good & corpus.good_score(F.col("score"))
    shards = docs.select("shard").distinct().count()
    split = corpus.validation_quota(docs, "shard", "doc_id", good, val_docs, shards, SEED)
    split.select(F.col("doc_id").alias("ord"), "split", _encoded(F.col("text"), tokenizer).alias("ids")).write.partitionBy("split").parquet(f"{out}/ids")
    schema = "ord long, ids array<int>, split string"
    counts, sizes = {}, {r.split: r.n for r in spark.read.schema(schema).parquet(f"{out}/ids").groupBy("split").agg(F.count("*").alias("n")).collect()}
    for name in ("train", "val"):
        counts[name] = sinks.token_binary(spark.read.schema(schema).parquet(f"{out}/ids").where(F.col("split") == name), "ord", "ids", f"{out}/{name}")["n_tokens"]
    kept = sum(sizes.values())
    meta = {"stage": "pretrain", "splits": counts, **_vocabulary(tokenizer), "n_blocks": bl.count_blocks(counts["train"], block), "block_size": block, "documents_kept": kept, "documents_dropped": docs.count() - kept, "keep_fraction": keep, "min_words": corpus.MIN_WORDS, "min_language_score": corpus.MIN_SCORE}
    return _saved_meta(spark, out, meta, began)


def _shares(spark: SparkSession, chats: DataFrame, tokenizer: str, out: str, threshold: float) -> DataFrame:
    """Conversations (chat, text, row_ord) with their ids, the mask of the owner's replies and the pool of their chat, written once."""
    coded = chats.select("chat", "row_ord", tk.encode_with_offsets(F.col("text"), tokenizer, tk.MARKS).alias("e"), tk.owner_spans(F.col("text")).alias("s"))
    coded.select("chat", "row_ord", F.col("e.ids").alias("ids"), tk.within(F.col("s"), F.col("e")).alias("mask")).write.parquet(f"{out}/chats")
    saved = spark.read.parquet(f"{out}/chats")
    return msg.pools(saved, msg.share_of_masks(saved, "mask", threshold))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return sources.json_lines(spark, path, sources.HOLDOUT).withColumn("row_ord", F.monotonically_increasing_id())


def stage_c(spark: SparkSession, chats: str, small: str, pretrain: str, out: str, tokenizer: str, val: str | None = None, replay: float = 0.25, upsample: int = 3, threshold: float = 0.2) -> dict:
    """Conversations of chats whose owner hardly speaks, a small corpus `upsample` times, and a slice of the pretraining stream for replay, to token files under out; every token counts."""
    began = time.time()
    pooled = _shares(spark, _lines(spark, chats), tokenizer, out, threshold)
    low = pooled.where("pool = 'low'")
    end = F.array(F.lit(tk.mark_ids(tokenizer)[END]))
    texts = _lines(spark, small).select("row_ord", _encoded(F.col("text"), tokenizer).alias("ids"))
    first = low.select(F.lit(0).alias("rank"), F.lit(0).alias("copy_no"), "row_ord", F.concat("ids", end).alias("ids"))
    more = corpus.replicated(texts, upsample).select(F.lit(1).alias("rank"), "copy_no", "row_ord", "ids")
    first.unionByName(more).write.parquet(f"{out}/primary")
    primary = spark.read.parquet(f"{out}/primary")
    n_primary = primary.agg(F.sum(F.size("ids")).cast("long")).first()[0] or 0
    stream = spark.read.parquet(f"{pretrain}/ids").where("split = 'train'")
    n_stream = stream.agg(F.sum(F.size("ids")).cast("long")).first()[0] or 0
    target = bl.replay_target(n_primary, replay)
    part = bl.contiguous_slice(stream, "ord", "ids", bl.slice_start(n_stream, target, SEED), target)
    both = primary.unionByName(part.select(F.lit(2).alias("rank"), F.lit(0).alias("copy_no"), F.col("pos").alias("row_ord"), F.col("tokens").alias("ids")))
    counts = {"train": _written(spark, _numbered(both, "rank", "copy_no", "row_ord").select("ord", "ids"), out, "train")["n_tokens"]}
    if val:
        counts["val"] = _written(spark, _lines(spark, val).select(F.col("row_ord").alias("ord"), _encoded(F.col("text"), tokenizer).alias("ids")), out, "val")["n_tokens"]
    low.select("chat").distinct().orderBy("chat").write.json(f"{out}/chats_used")
    n_replay = counts["train"] - n_primary
    meta = {"stage": "stage_c", "splits": counts, "primary_tokens": n_primary, "replay_tokens": n_replay, "replay_fraction_actual": round(n_replay / max(counts["train"], 1), 4), **_vocabulary(tokenizer), "me_share_threshold": threshold}
    return _saved_meta(spark, out, meta, began)


def stage_d(spark: SparkSession, chats: str, val: str, out: str, tokenizer: str, threshold: float = 0.2) -> dict:
    """Conversations of the other chats, to token files with masks under out: all is read, only the owner's replies count, and the end mark between conversations doesn't."""
    began = time.time()
    end, found = F.array(F.lit(tk.mark_ids(tokenizer)[END])), {}
    for name, path in (("train", chats), ("val", val)):
        rows = _shares(spark, _lines(spark, path), tokenizer, f"{out}/{name}-coded", threshold)
        rows = rows.where("pool = 'high'") if name == "train" else rows
        ids = rows.select(F.col("row_ord").alias("ord"), F.concat("ids", end).alias("ids"), F.concat("mask", F.array(F.lit(0))).alias("mask"))
        found[name] = _written(spark, ids, out, name, "mask")
    train = found["train"]
    meta = {"stage": "stage_d", "loss_on": "owner replies only", "splits": {k: v["n_tokens"] for k, v in found.items()}, "scored_tokens": {k: v["n_scored"] for k, v in found.items()}, "scored_fraction": round(train["n_scored"] / max(train["n_tokens"], 1), 4), "me_share_threshold": threshold, **_vocabulary(tokenizer)}
    return _saved_meta(spark, out, meta, began)


def settings(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="job", required=True)
    m = sub.add_parser("messages")
    m.add_argument("--path")
    m.add_argument("--out")
    m.add_argument("--pseudonymize", action="store_true", default=None)
    m.add_argument("--val-fraction", type=float)
    k = sub.add_parser("pack")
    k.add_argument("--docs")
    k.add_argument("--out")
    k.add_argument("--tokenizer")
    k.add_argument("--block", type=int)
    k.add_argument("--limit-shards", type=int)
    k.add_argument("--val-docs", type=int)
    for name in ("stage-c", "stage-d"):
        c = sub.add_parser(name)
        for option in ("--chats", "--val", "--out", "--tokenizer", *(["--small", "--pretrain"] if name == "stage-c" else [])):
            c.add_argument(option)
        c.add_argument("--threshold", type=float)
        if name == "stage-c":
            c.add_argument("--replay", type=float)
            c.add_argument("--upsample", type=int)
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--sf-dir")
    q.add_argument("--out")
    args = p.parse_args(argv)
    if args.config:
        with open(args.config) as f:
            held = json.load(f)
        for name, value in held.items():
            if getattr(args, name, 0) is None:
                setattr(args, name, value)
    return args


def given(args: argparse.Namespace, *names: str) -> dict:
    """Settings that were given, whatever their value; for the others the job's defaults hold."""
    return {n: getattr(args, n) for n in names if getattr(args, n) is not None}


def main(argv: list[str] | None = None) -> None:
    args = settings(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tokenizer = getattr(args, "tokenizer", None) or tk.TOKENIZER
    if args.job == "messages":
        print(messages(spark, args.path, args.out, **given(args, "pseudonymize", "val_fraction")))
    elif args.job == "pack":
        docs = sources.web_shards(spark, args.docs, args.limit_shards)
        docs = docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.monotonically_increasing_id())
        score = [F.col("metadata.labels.language_score").alias("score")] if "metadata" in docs.columns else []
        print(pack(spark, docs.select("doc_id", "text", "shard", *score), args.out, tokenizer, **given(args, "block", "val_docs")))
    elif args.job == "stage-c":
        print(stage_c(spark, args.chats, args.small, args.pretrain, args.out, tokenizer, **given(args, "val", "replay", "upsample", "threshold")))
    elif args.job == "stage-d":
        print(stage_d(spark, args.chats, args.val, args.out, tokenizer, **given(args, "threshold")))
    else:
        queries = sources.Registry("query")
        queries.known = plans.queries()
        queries[args.name](spark, args.sf_dir).write.parquet(args.out)


if __name__ == "__main__":
    main()
