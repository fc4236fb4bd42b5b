"""A message log as conversations: sessions, runs of one speaker, greedy chunks, rendering, whole-chat hold-out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

GAP_HOURS, MAX_TURNS, MAX_CHARS, MIN_TURNS = 6, 30, 2000, 2
ORDER = ["ts", "row_ord"]


def typed_messages(raw: DataFrame, mask_phones: bool = False) -> DataFrame:
    """(chat, ts, speaker, text, row_ord) of a raw log: only incoming and outgoing rows with a text and a readable time."""
    clean = tx.clean_message(F.coalesce(F.col("Text"), F.lit("")), mask_phones)
    rows = raw.where(F.col("Type").isin("Incoming", "Outgoing"))
    rows = rows.select(F.col("`Chat Session`").alias("chat"), tx.message_time(F.col("`Message Date`")).alias("ts"), tx.speaker(F.col("Type"), F.col("`Sender Name`"), F.col("`Chat Session`")).alias("speaker"), clean.alias("text"), "row_ord")
    return rows.where((F.col("text") != "") & F.col("ts").isNotNull())


def sessions(messages: DataFrame, gap_hours: int = GAP_HOURS) -> DataFrame:
    """Adds session_no: a gap of more than gap_hours to the message before begins a session; one of just so many doesn't."""
    w = Window.partitionBy("chat").orderBy(*ORDER)
    late = F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {gap_hours} HOURS")
    return messages.withColumn("__new", F.coalesce(late, F.lit(False)).cast("int")).withColumn("session_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def runs(with_sessions: DataFrame) -> DataFrame:
    """(chat, session_no, run_no, speaker, text): messages that follow each other from one speaker, their texts joined by a blank."""
    w = Window.partitionBy("chat", "session_no").orderBy(*ORDER)
    other = F.coalesce(F.col("speaker") != F.lag("speaker").over(w), F.lag("ts").over(w).isNotNull() & F.col("speaker").isNull())
    marked = with_sessions.withColumn("__new", F.coalesce(other, F.lit(False)).cast("int")).withColumn("run_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(*ORDER, F.coalesce("text", F.lit("")).alias("text"))))
    return marked.groupBy("chat", "session_no", "run_no").agg(F.first("speaker").alias("speaker"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def _greedy(max_turns: int, max_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, turns, chars = None, 0, 0, 0
        for batch in batches:
            out = []
            for k, n in zip(zip(batch["chat"], batch["session_no"]), batch["n"]):
                if k != key:
                    key, chunk, turns, chars = k, 0, 0, 0
                elif turns and (turns >= max_turns or chars + n > max_chars):
                    chunk, turns, chars = chunk + 1, 0, 0
                turns, chars = turns + 1, chars + n
                out.append(chunk)
            yield batch.drop(columns="n").assign(chunk_no=out)

    return run


def chunks(merged: DataFrame, max_turns: int = MAX_TURNS, max_chars: int = MAX_CHARS, min_turns: int = MIN_TURNS) -> DataFrame:
    """Adds chunk_no to runs; chunks of fewer than min_turns turns go.

    A chunk is closed before a turn that would be one too many, or would take it beyond max_chars; a longer turn has
    a chunk to itself until the next. One pass over rows sorted within their session: no session is held in memory,
    and sessions of one chat are spread over tasks.
    """
    ordered = merged.repartition("chat", "session_no").sortWithinPartitions("chat", "session_no", "run_no").withColumn("n", F.length("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in merged.schema) + ", chunk_no long"
    placed = ordered.mapInPandas(_greedy(max_turns, max_chars), schema)
    of = Window.partitionBy("chat", "session_no", "chunk_no")
    return placed.withColumn("__n", F.count("*").over(of)).where(F.col("__n") >= min_turns).drop("__n")


def turn(who: Column, what: Column) -> Column:
    return F.concat(F.lit("<|turn|>"), who, F.lit(": "), what, F.lit("<|end|>"))


def conversations(chunked: DataFrame) -> DataFrame:
    """(chat, session_no, chunk_no, n_turns, text): each chunk as marked-up text."""
    parts = F.array_sort(F.collect_list(F.struct("run_no", turn(F.coalesce("speaker", F.lit("")), F.col("text")).alias("t"))))
    body = F.array_join(F.transform(parts, lambda x: x["t"]), "")
    return chunked.groupBy("chat", "session_no", "chunk_no").agg(F.count("*").alias("n_turns"), F.concat(F.lit("<s><|conv|>"), body, F.lit("</s>")).alias("text"))


def hold_out(sizes: DataFrame, fraction: float = 0.03, seed: int = 67) -> DataFrame:
    """Adds held to (chat, n): whole chats in shuffled order until their share of conversations is reached.

    A chat of more than one and a half times the target is passed over once one has been taken. Each choice depends
    on all before it, so the chats, a row each, go through one task in order, and none of them is held in memory.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    target = total * fraction

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        running, some = 0, False
        for batch in batches:
            held = []
            for n in batch["n"]:
                take = running < target and not (some and n > 1.5 * target)
                if take:
                    running, some = running + n, True
                held.append(take)
            yield batch.assign(held=held)

    ordered = sizes.withColumn("__at", tx.shuffle_order(F.col("chat"), seed)).repartition(1).sortWithinPartitions("__at", "chat").drop("__at")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sizes.schema) + ", held boolean"
    return ordered.mapInPandas(run, schema)


def owner_share(chunked: DataFrame, owner: Column, threshold: float = 0.2) -> DataFrame:
    """(chat, n_tokens, n_owner, share, pool): a chat's share of tokens that count as its owner's replies; below the threshold it is in the low pool.

    Tokens are the words and marks of rendered conversations: three around each conversation, a mark, a label and an end
    mark for each turn. The owner's are the words and end mark of its turns, not their labels.
    """
    n = tx.word_count(F.col("text"))
    first = F.col("run_no") == F.min("run_no").over(Window.partitionBy("chat", "session_no", "chunk_no"))
    cells = chunked.select("chat", (n + 3 + F.when(first, 3).otherwise(0)).alias("n"), F.when(owner, n + 1).otherwise(F.lit(0)).alias("own"))
    own = cells.groupBy("chat").agg(F.sum("n").alias("n_tokens"), F.sum("own").alias("n_owner"))
    share = F.col("n_owner") / F.greatest(F.col("n_tokens"), F.lit(1))
    return own.withColumn("share", share).withColumn("pool", F.when(F.col("share") < threshold, "low").otherwise("high"))


def share_of_masks(rows: DataFrame, mask: str, threshold: float = 0.2) -> DataFrame:
    """The same from conversations (chat, mask), a flag for each of their tokens."""
    own = rows.groupBy("chat").agg(F.sum(F.size(mask)).alias("n_tokens"), F.sum(F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_owner"))
    share = F.col("n_owner") / F.greatest(F.col("n_tokens"), F.lit(1))
    return own.withColumn("share", share).withColumn("pool", F.when(F.col("share") < threshold, "low").otherwise("high"))


def pools(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """rows of chats with the pool that their chat is in; a chat that has no share is in the high one, as it isn't below the threshold."""
    of = shares.select(F.col("chat").alias("__chat"), F.col("pool").alias("__pool"))
    return rows.join(of, F.col("chat").eqNullSafe(F.col("__chat")), "left").withColumn("pool", F.coalesce("__pool", F.lit("high"))).drop("__chat", "__pool")
