"""Writers. Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

LOG = logging.getLogger(__name__)


def json_lines(df: DataFrame, path: str, order: list[str]) -> int:
    """JSON lines in order; the number of rows, counted as they are written."""
    seen = Observation()
    # Above the sort: it looks at its input twice, once to choose the ranges.
    df.orderBy(*order).observe(seen, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def splits(df: DataFrame, path: str, by: str = "split") -> None:
    """A Parquet folder for each split, in one pass."""
    df.write.partitionBy(by).parquet(path)


def token_table(stream: DataFrame, path: str) -> dict:
    """The stream as Parquet, with the counts of its tokens and scored tokens."""
    seen = Observation()
    scored = F.count_if("scored") if "scored" in stream.columns else F.count(F.lit(1))
    stream.observe(seen, F.count(F.lit(1)).alias("n_tokens"), scored.alias("n_scored")).write.parquet(path)
    return dict(seen.get)


def token_binary(docs: DataFrame, order: str, ids: str, path: str, mask: str | None = None) -> dict:
    """The documents' tokens in order as 16-bit little-endian files under path, with a file of one byte flags beside each if there is a mask; the counts of tokens and scored tokens.

    A part holds a range of the order, and parts follow each other by name, so put behind one another they are the
    stream; sources.token_stream reads them. An id beyond 16 bits, or a mask of another length than its tokens, is an error. A null mask
    scores all tokens. A part is written beside its name and renamed, so a task that is run again does no harm.
    """
    cells = [F.col(order).alias("o"), F.col(ids).alias("ids")] + ([F.col(mask).cast("array<int>").alias("mask")] if mask else [])
    rows = docs.where(F.size(ids) > 0).select(*cells).repartitionByRange("o").sortWithinPartitions("o").select(F.spark_partition_id().alias("part"), "*")

    def write(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(folder, recursive=True)
        beside, out, part, total, scored = f"{folder}/_{uuid.uuid4().hex}", [], None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column(0)[0].as_py()
                out = [system.open_output_stream(f"{beside}.{end}") for end in (["bin", "mask"] if mask else ["bin"])]
            values = batch.column(2).flatten().to_numpy()
            if len(values) and not 0 <= values.min() <= values.max() < 1 << 16:
                raise ValueError(f"ids from {values.min()} to {values.max()} don't fit into 16 bits")
            out[0].write(values.astype("<u2").tobytes())
            total += len(values)
            if mask:
                sizes, own = batch.column(2).value_lengths().to_numpy(), batch.column(3)
                lengths = own.value_lengths().fill_null(-1).to_numpy()
                wrong = np.flatnonzero((lengths >= 0) & (lengths != sizes))
                if len(wrong):
                    raise ValueError(f"a mask of {lengths[wrong[0]]} flags for {sizes[wrong[0]]} tokens")
                flags = np.ones(len(values), np.uint8)
                flags[np.repeat(lengths >= 0, sizes)] = own.flatten().to_numpy()
                out[1].write(flags.tobytes())
                scored += int(flags.sum())
        if part is not None:
            for stream, end in zip(out, ("bin", "mask")):
                stream.close()
                system.move(f"{beside}.{end}", f"{folder}/part-{part:06d}.{end}")
            yield pa.record_batch([pa.array([total]), pa.array([scored if mask else total])], names=["n_tokens", "n_scored"])

    counts = rows.mapInArrow(write, "n_tokens long, n_scored long").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_scored").alias("n_scored")).first()
    return {"n_tokens": counts.n_tokens or 0, "n_scored": counts.n_scored or 0}


def append_samples(df: DataFrame, path: str) -> None:
    """(step, prompt, temperature, text) rows are added to a table."""
    df.select("step", "prompt", "temperature", "text").write.mode("append").parquet(path)


class Progress(StreamingQueryListener):
    """Logs rows and their rate after every so many batches of a stream: spark.streams.addListener(Progress())."""

    def __init__(self, every: int = 25):
        self.every, self.rows, self.began = every, 0, time.time()

    def onQueryStarted(self, event) -> None:
        self.rows, self.began = 0, time.time()

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if (event.progress.batchId + 1) % self.every == 0:
            LOG.info("batch %d, %d rows, %.0f a second", event.progress.batchId, self.rows, self.rows / max(time.time() - self.began, 1e-9))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        LOG.info("ended after %d rows", self.rows)


def append_metrics(df: DataFrame, path: str) -> None:
    """(step, metric, value) rows are added to a table."""
    df.select("step", "metric", "value").write.mode("append").parquet(path)


def meta(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.json(path)
