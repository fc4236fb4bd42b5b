"""Readers: each has a schema of its own, and none of them infers one."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BLANKS

LOG = logging.getLogger(__name__)
MESSAGE_LOG = "`Chat Session` string, `Message Date` string, Type string, `Sender Name` string, Text string"
WEB = "text string, metadata struct<token_count:long, labels:struct<language_score:double>>"
INSTRUCTIONS = "messages array<struct<role:string, content:string>>"


def _ordered(df: DataFrame) -> DataFrame:
    """Adds row_ord: rows in order of file and place in it."""
    return df.withColumn("row_ord", F.monotonically_increasing_id())


def message_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV log with quoted fields that may span lines."""
    return _ordered(spark.read.schema(MESSAGE_LOG).options(header=True, multiLine=True, quote='"', escape='"', enforceSchema=False).csv(path))


def message_texts(spark: SparkSession, path: str) -> DataFrame:
    """Only the texts of a log's incoming and outgoing messages, without blanks at their ends; empty ones go. A missing log is none, with a warning."""
    if not files_of(spark, path):
        LOG.warning("%s not found, skipped", path)
        return spark.createDataFrame([], "text string, row_ord long")
    text = F.btrim("Text", F.lit(BLANKS)).alias("text")
    return message_log(spark, path).where(F.col("Type").isin("Incoming", "Outgoing")).select(text, "row_ord").where("text <> ''")


def labelled_lines(spark: SparkSession, path: str, stripped: bool = False) -> DataFrame:
    """The text before the first tab of each line; quotes mean nothing. `stripped` takes blanks off its ends and leaves empty ones out."""
    lines = _ordered(spark.read.text(path).select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("text")))
    return lines.withColumn("text", F.btrim("text", F.lit(BLANKS))).where("text <> ''") if stripped else lines


def json_lines(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """JSON lines; with a field only that one, so the reader parses no other."""
    df = spark.read.schema(schema).json(path)
    return df.select(field) if field else df


def web_shards(spark: SparkSession, path: str, limit_shards: int | None = None) -> DataFrame:
    """Parquet shards with the file's name as `shard`; limit_shards keeps the first by name, by leaving files out, not rows."""
    df = spark.read.parquet(path)
    if limit_shards is not None:
        files = sorted(df.inputFiles())[:limit_shards]
        if not files:
            raise FileNotFoundError(path)
        df = spark.read.schema(df.schema).parquet(*files)
    return df.withColumn("shard", F.col("_metadata.file_name"))


def instructions(spark: SparkSession, *paths: str) -> DataFrame:
    """Only the messages column of one or more Parquet tables."""
    return spark.read.parquet(*paths).select("messages")


def _arrow_batches(path: str):
    import pyarrow as pa

    with opened(path) as f:
        try:
            read = pa.ipc.open_file(f)
        except pa.ArrowInvalid:  # written as a stream instead
            f.seek(0)
            yield from pa.ipc.open_stream(f)
            return
        yield from (read.get_batch(k) for k in range(read.num_record_batches))


def arrow_files(spark: SparkSession, files: list[str], schema: str) -> DataFrame:
    """Arrow IPC files, each read by one task in order of their names; they must be where every executor sees them."""
    wanted = T._parse_datatype_string(schema).fieldNames() if not isinstance(schema, T.StructType) else schema.fieldNames()
    names = spark.createDataFrame([(f,) for f in sorted(files)], "path string").repartition(max(1, len(files)))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for part in _arrow_batches(path):
                    table = pa.Table.from_batches([part]).select(wanted)
                    yield from table.to_batches()

    return names.mapInArrow(read, schema)


def arrow_folder(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """(text) of every Arrow file below a folder, by name; empty ones go. A folder without any is none, with a warning."""
    found = files_of(spark, folder, ".arrow")
    if not found:
        LOG.warning("no Arrow file under %s, skipped", folder)
        return spark.createDataFrame([], "text string")
    return arrow_files(spark, found, f"`{column}` string").select(F.col(f"`{column}`").alias("text")).where("text <> ''")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def files_of(spark: SparkSession, path: str, ending: str = "") -> list[str]:
    """The files at or below a path, sorted, on whatever file system it names; none if there is nothing."""
    _, where, system = _hadoop(spark, path)
    if not system.exists(where):
        return []
    found, out = system.listFiles(where, True), []
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(ending) and not name.rsplit("/", 1)[1].startswith(("_", ".")):
            out.append(name)
    return sorted(out)


def size_of(spark: SparkSession, path: str) -> int:
    _, where, system = _hadoop(spark, path)
    return system.getFileStatus(where).getLen()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text, from whatever file system its path names."""
    jvm, where, system = _hadoop(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file and renames, so that no reader sees a part of it."""
    jvm, where, system = _hadoop(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(path + "._new")
    stream = system.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    system.delete(where, False)
    if not system.rename(beside, where):
        raise OSError(f"{path} can't be written")


def opened(path: str):
    """A file for random reads in a worker, from any file system that pyarrow knows."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def token_stream(spark: SparkSession, path: str, mask: str | None = None, at_once: int = 1 << 22) -> DataFrame:
    """(pos, token[, scored]) of a file of 16-bit little-endian ids, or a folder of such parts in order of their names, with one byte flags beside it. The two must have the same number of tokens, which their sizes tell. Ranges of at_once tokens are read as arrays, tokens and flags together."""

    parts = files_of(spark, path, ".bin") or [path]
    flags = [None] * len(parts) if not mask else files_of(spark, mask, ".mask") or [mask]
    ranges, start = [], 0
    for file, beside in zip(parts, flags, strict=True):
        n = size_of(spark, file) // 2
        if beside and size_of(spark, beside) != n:
            raise ValueError(f"{beside} has {size_of(spark, beside)} flags for {n} tokens")
        ranges += [(file, beside, low, min(n - low, at_once), start + low) for low in range(0, n, at_once)]
        start += n
    schema = "pos long, token int" + (", scored boolean" if mask else "")
    if not ranges:
        return spark.createDataFrame([], schema)

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["file"]) as f:
                    tokens = np.frombuffer(f.read_at(2 * r["n"], 2 * r["low"]), "<u2").astype(np.int32)
                columns = [pa.array(np.arange(r["pos"], r["pos"] + r["n"])), pa.array(tokens)]
                if mask:
                    with opened(r["mask"]) as f:
                        columns.append(pa.array(np.frombuffer(f.read_at(r["n"], r["low"]), np.uint8) != 0))
                yield from pa.Table.from_arrays(columns, names=["pos", "token", "scored"][: len(columns)]).to_batches(max_chunksize=65_536)

    todo = spark.sparkContext.parallelize(ranges, min(len(ranges), 100_000))
    return spark.createDataFrame(todo, "file string, mask string, low long, n long, pos long").mapInArrow(read, schema)


def fingerprint(path: str) -> str:
    """Of a vocabulary's file, which lies on every machine."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def fingerprint_of(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def checked_meta(spark: SparkSession, path: str, tokenizer_fingerprint: str) -> dict:
    """A pack's metadata; an error if it was made with another tokenizer."""
    meta = json.loads(read_text(spark, path))
    if meta.get("tokenizer_fingerprint") != tokenizer_fingerprint:
        raise ValueError(f"{path} was packed with tokenizer {meta.get('tokenizer_fingerprint')}, not {tokenizer_fingerprint}")
    return meta


def saved_cursor(spark: SparkSession, path: str, position: int, seed: int) -> None:
    write_text(spark, path, json.dumps({"position": position, "seed": seed}))


def read_cursor(spark: SparkSession, path: str, seed: int = 67) -> tuple[int, int]:
    """(position, seed) to go on from; the start if nothing was saved."""
    if not files_of(spark, path):
        return 0, seed
    held = json.loads(read_text(spark, path))
    return held["position"], held.get("seed", seed)


class Registry:
    """Builders by name; an unknown name is an error that lists those there are."""

    def __init__(self, what: str):
        self.what, self.known = what, {}

    def add(self, name: str) -> Callable:
        def take(f):
            self.known[name] = f
            return f

        return take

    def __getitem__(self, name: str) -> Callable:
        if name not in self.known:
            raise KeyError(f"unknown {self.what} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]


READERS = Registry("source")
for _f in (message_log, message_texts, labelled_lines, json_lines, web_shards, instructions, arrow_files, arrow_folder, token_stream):
    READERS.add(_f.__name__)(_f)


@dataclass(frozen=True)
class Source:
    """A named data set: where its splits lie, the reader for them, and how many examples at most are taken, by row order."""

    reader: str
    paths: dict[str, str]
    options: dict
    limit: int | None = None

    def read(self, spark: SparkSession, split: str) -> DataFrame:
        if split not in self.paths:
            raise KeyError(f"no split {split!r}; known: {', '.join(sorted(self.paths))}")
        rows = READERS[self.reader](spark, self.paths[split], **self.options)
        if self.limit is None:
            return rows
        rows = rows if "row_ord" in rows.columns else _ordered(rows)
        return rows.orderBy("row_ord").limit(self.limit)


PARALLEL = "dialect string, standard string"
HOLDOUT = "chat string, text string"
#: Loaders by name: each makes a Source of the paths of its splits.
LOADERS = Registry("loader")
LOADERS.add("packed")(lambda paths, **o: Source("token_stream", paths, o))
LOADERS.add("arabic")(lambda paths, limit_shards=None: Source("web_shards", paths, {"limit_shards": limit_shards}))
LOADERS.add("arabic_ift")(lambda paths: Source("instructions", paths, {}))
LOADERS.add("mmlu")(lambda paths, schema, limit=None: Source("json_lines", paths, {"schema": schema}, limit))
LOADERS.add("flores")(lambda paths, schema=PARALLEL, limit=None: Source("json_lines", paths, {"schema": schema}, limit))
LOADERS.add("chat_holdout")(lambda paths, limit=None: Source("json_lines", paths, {"schema": HOLDOUT}, limit))
