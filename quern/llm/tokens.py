"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, n_tokens int, tokens array<int>"
#: Characters that the tokenizer gets at once; longer texts are cut before a blank, where no token can span.
PIECE = 200_000


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """Parts of a text whose tokens together are the text's: each cut is before a single blank between two letters."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    encoding = _encoding(path)
    return [np.concatenate([np.asarray(encoding.encode_ordinary(p), np.int32) for p in pieces(t)]) for t in texts]


def tokenized(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, tokens) of the whole text of each row; a null text has null tokens, an empty one none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(1).to_pylist()
                found = encode([t or "" for t in texts], path)
                sizes = np.array([len(x) for x in found], np.int32)
                null = np.array([t is None for t in texts], bool)
                values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
                lists = lists.filter(pa.array(~null)).take(pa.array(np.where(null, -1, np.cumsum(~null) - 1), mask=null)) if null.any() else lists
                yield pa.record_batch([part.column(0), pa.array(sizes, mask=null), lists], names=["doc_id", "n_tokens", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def counted(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """rows with n, the number of tokens of the whole of their text, instead of text; 0 for a null or empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n = [len(x) for x in encode([t or "" for t in part.column(at).to_pylist()], path)]
                kept = [k for k in range(part.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(n, pa.int64())], names=[*(part.schema.names[k] for k in kept), "n"])

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"]).add("n", "long")
    return rows.mapInArrow(run, schema)


def write_orc(docs: DataFrame, where: str, path: str = TOKENIZER, stripe_bytes: int = 64 << 20, index_rows: int = 1000, false_positives: float = 0.01) -> None:
    """Tokenises docs into ORC files, one for each range of doc_id, in order of doc_id inside a file.

    Integers are run-length encoded by the format. Every index_rows rows have an index entry with the least and greatest
    doc_id, and a Bloom filter, so a reader skips stripes and row groups from metadata. Rows are sorted by ranges first,
    whatever order the corpus lies in, so the stripes' ranges of ids don't overlap; texts move once.

    Null ids come first; null texts keep their row with null tokens; rows that repeat are all written, and an id with
    very many rows is spread over files by its texts; other columns aren't written; an empty table makes an empty one
    that reads back with the schema.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    options = {
        "orc.stripe.size": stripe_bytes,
        "orc.row.index.stride": index_rows,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": false_positives,
        "orc.compress": "ZSTD",
        # Long documents fill a stripe in far fewer rows than the default of 5000 between two looks at its size.
        "orc.rows.between.memory.checks": 100,
    }
    tokenized(ordered, path).write.options(**{k: str(v) for k, v in options.items()}).orc(where)


def read_orc(spark: SparkSession, where: str, ids: list[int] | None = None) -> DataFrame:
    """The table that write_orc made, read by stripes in parallel. With ids, only those documents: the condition goes down to the reader, which leaves out stripes and row groups by their ranges and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(where)
    return df if ids is None else df.where(F.col("doc_id").isin(ids))


def stripes(spark: SparkSession, where: str) -> list[dict]:
    """(file, stripe, offset, length, rows, low, high) of each stripe of the table, low and high being its least and greatest doc_id or None where all are null. Only the files' footers are read, through Hadoop's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(where)
    out = []
    for status in folder.getFileSystem(conf).listStatus(folder):
        if not status.getPath().getName().endswith(".orc"):
            continue
        reader = jvm.org.apache.orc.OrcFile.createReader(status.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        statistics = reader.getStripeStatistics()
        for k, s in enumerate(reader.getStripes()):
            id_statistics = statistics[k].getColumnStatistics()[1]
            some = id_statistics.getNumberOfValues() > 0
            out.append({"file": status.getPath().toString(), "stripe": k, "offset": s.getOffset(), "length": s.getLength(), "rows": s.getNumberOfRows(), "low": id_statistics.getMinimum() if some else None, "high": id_statistics.getMaximum() if some else None})
    return sorted(out, key=lambda x: (x["file"], x["stripe"]))


def read_stripe(file: str, k: int) -> pa.RecordBatch:
    """One stripe, from any file system that pyarrow knows."""
    from pyarrow import fs, orc

    system, path = fs.FileSystem.from_uri(file) if "://" in file or file.startswith("file:") else (fs.LocalFileSystem(), file)
    with system.open_input_file(path) as f:
        return orc.ORCFile(f).read_stripe(k)


def read_stripes(spark: SparkSession, where: str, ids: list[int] | None = None) -> DataFrame:
    """The table that write_orc made, a task for each stripe. With ids, only stripes whose range holds one are read, and of these only such rows."""
    chosen = stripes(spark, where)
    if ids is not None:
        chosen = [s for s in chosen if s["low"] is not None and any(s["low"] <= i <= s["high"] for i in ids)]
    if not chosen:
        return spark.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from pa.Table.from_batches([read_stripe(file, k)]).select(["doc_id", "n_tokens", "tokens"]).to_batches(max_chunksize=1024)

    # Records of a Python RDD are cut into as many partitions as asked for.
    todo = spark.createDataFrame(spark.sparkContext.parallelize([(s["file"], s["stripe"]) for s in chosen], len(chosen)), "file string, stripe int")
    df = todo.mapInArrow(run, SCHEMA)
    return df if ids is None else df.where(F.col("doc_id").isin(ids))
