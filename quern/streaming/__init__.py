"""The sequence operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import throughput


def files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", at_once: int = 1) -> DataFrame:
    """A folder as a stream, at most so many new files a batch: rows are pulled as they are asked for, and a restart goes on behind the last batch that was finished."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).format(kind).load(path)


def sessions(messages: DataFrame, gap: str = "6 hours", late: str = "0 seconds") -> DataFrame:
    """(chat, started, ended, n): closed sessions of a stream of (chat, ts, ...), ts a timestamp with a zone.

    A session is given out once the watermark is past its last message and the gap; rows that come after are dropped.
    """
    grouped = messages.withWatermark("ts", late).groupBy("chat", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended")).select("chat", "started", "ended", "n")


def first_of_each(rows: DataFrame, text: str, time: str, late: str) -> DataFrame:
    """The first row of each text to arrive, as long as the watermark allows for."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([text])


def log_windows(rows: DataFrame, every: int, tokens_per_step: int | None = None, flops_per_token: float = 0.0, peak: float = 1.0) -> DataFrame:
    """(window_no, n, loss[, tokens_per_sec, mfu, tokens_seen]): means over windows of `every` steps, steps from 1. With tokens_per_step, rows have the seconds that a step took."""
    aggs = [F.count("*").alias("n"), F.avg("loss").alias("loss")]
    if tokens_per_step:
        rate, share = throughput(F.count("*") * tokens_per_step, F.sum("seconds"), flops_per_token, peak)
        aggs += [rate.alias("tokens_per_sec"), share.alias("mfu"), (F.max("step") * F.lit(tokens_per_step).cast("long")).alias("tokens_seen")]
    return rows.groupBy(F.floor((F.col("step") - 1) / every).alias("window_no")).agg(*aggs)


def improved(rows: DataFrame) -> DataFrame:
    """(run, step, value, improved) of (run, step, value): whether a value is below all that its run has had before, kept as state."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else float("inf")
        part = pd.concat(list(batches)).sort_values("step")
        flags = []
        for v in part["value"]:
            flags.append(bool(v < best))
            best = min(best, v) if v == v else best
        state.update((best,))
        yield part.assign(improved=flags)[["run", "step", "value", "improved"]]

    return rows.groupBy("run").applyInPandasWithState(step, "run string, step long, value double, improved boolean", "best double", "append", "NoTimeout")


def chunks(turns: DataFrame, max_turns: int = 30, max_chars: int = 2000) -> DataFrame:
    """(chat, session_no, turn_no, chunk_no) of (chat, session_no, turn_no, n_chars): the greedy chunk rule with the open chunk of each session kept as state, so a new session begins with a new chunk."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        chunk, size, chars = state.get if state.exists else (0, 0, 0)
        part = pd.concat(list(batches)).sort_values("turn_no")
        out = []
        for n in part["n_chars"]:
            if size and (size >= max_turns or chars + n > max_chars):
                chunk, size, chars = chunk + 1, 0, 0
            size, chars = size + 1, chars + int(n)
            out.append(chunk)
        state.update((chunk, size, chars))
        yield part.assign(chunk_no=out)[["chat", "session_no", "turn_no", "chunk_no"]]

    return turns.groupBy("chat", "session_no").applyInPandasWithState(step, "chat string, session_no long, turn_no long, chunk_no long", "chunk long, size long, chars long", "append", "NoTimeout")
