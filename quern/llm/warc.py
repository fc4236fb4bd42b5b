"""WARC transactions: request, response and metadata records joined through their concurrent-to identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .minhash import components
from .shared import Scratch

#: Types of the record that a capture is about; it is the capture's `response`.
ANCHORS = ["response", "revisit", "resource"]
PAYLOAD = ["target_uri", "date", "content_type", "block"]


def _named(records: DataFrame) -> DataFrame:
    """Records with an id each, without other columns, and with hashes of the whole row to choose by among those of one id."""
    columns = [F.col(c).cast("string").alias(c) for c in ("type", *PAYLOAD)]
    own = records.select(F.col("record_id").cast("string").alias("record_id"), *columns, F.col("concurrent_to"))
    whole = F.sha2(F.to_json(F.struct("type", *PAYLOAD, "concurrent_to")), 256)
    # As columns, so that a plan which doesn't need the blocks doesn't carry them to its sort.
    ties = [F.xxhash64(F.lit(k), "type", *PAYLOAD).alias(f"tie{k}") for k in (1, 2)]
    return own.select(F.coalesce("record_id", F.concat(F.lit("#"), whole)).alias("record_id"), "type", *PAYLOAD, "concurrent_to", *ties)


def _one_each(named: DataFrame) -> DataFrame:
    first = Window.partitionBy("record_id").orderBy("tie1", "tie2")
    return named.withColumn("turn", F.row_number().over(first)).where("turn = 1")


def captures_of(records: DataFrame, scratch: Scratch) -> DataFrame:
    """(record_id, capture_id) of every record that isn't an anchor, from ids and links alone.

    A record goes to the anchor that the fewest links away from it, in either direction; of several, to the one of
    least id. Records that reach no anchor are a capture of their own for each connected set, named by its least id.
    """
    anchor = F.coalesce(F.col("type").isin(ANCHORS), F.lit(False))
    slim = scratch.save(records.select(F.col("record_id").cast("string").alias("record_id"), anchor.alias("anchor"), "concurrent_to"), "slim")
    ids = slim.groupBy("record_id").agg(F.max("anchor").alias("anchor"))
    ids = scratch.save(ids, "ids")
    there = slim.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).where("b is not null and a <> b")
    # A link to a record that isn't in the table leads nowhere.
    there = there.join(ids.select(F.col("record_id").alias("b")), "b", "left_semi").select("a", "b")
    links = scratch.save(there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    frontier = ids.where("anchor").select("record_id", F.col("record_id").alias("capture_id"))
    open_ids = ids.where("not anchor").select("record_id")
    found, step = [], 0
    while True:
        step += 1
        reached = links.join(frontier.withColumnRenamed("record_id", "b"), "b").groupBy(F.col("a").alias("record_id")).agg(F.min("capture_id").alias("capture_id"))
        reached = scratch.save(reached.join(open_ids, "record_id", "left_semi"), f"reached-{step}")
        if not reached.limit(1).count():
            break
        found.append(reached)
        frontier = reached
        open_ids = scratch.save(open_ids.join(reached, "record_id", "left_anti"), f"open-{step}")
    lone = links.join(open_ids.withColumnRenamed("record_id", "a"), "a", "left_semi").select("a", "b")
    if lone.limit(1).count():
        tops = components(lone, scratch, "lone")
        found.append(open_ids.join(tops.withColumnRenamed("node", "record_id"), "record_id", "left").select("record_id", F.coalesce("label", "record_id").alias("capture_id")))
    else:
        found.append(open_ids.select("record_id", F.col("record_id").alias("capture_id")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, target_uri, date, response, requests, metadata, others, n_records).

    records has record_id, type, target_uri, date, content_type, block and concurrent_to, an array of record ids; other
    columns aren't read. `response` is the anchor record, null for records that reach none; the arrays hold structs
    in order of record id, empty if there is none; each record keeps its concurrent_to. target_uri and date are the response's, else the least among the
    other records. Null or empty blocks and links stay as they are; a record without an id gets one from its content;
    rows that
    repeat an id are one record with the links of all of them, an anchor if one of them is.

    Links are resolved on ids alone; a response's block is moved once, to the requests and metadata that found it.
    """
    scratch = Scratch(records.sparkSession, "warc")
    own = _named(records)
    capture = captures_of(own, scratch)
    anchor = F.coalesce(F.col("type").isin(ANCHORS), F.lit(False))
    record = F.struct("record_id", "type", *PAYLOAD, "concurrent_to")
    # Each side is cut out before its ids are made unique, so a block is moved with its own side only.
    rest = _one_each(own.where(~anchor)).join(capture, "record_id")
    held = rest.groupBy("capture_id").agg(F.array_sort(F.collect_list(record)).alias("held"), F.min("target_uri").alias("uri"), F.min("date").alias("at"))
    heads = _one_each(own.where(anchor)).select(F.col("record_id").alias("head_id"), record.alias("response"))
    both = heads.join(held, F.col("head_id") == F.col("capture_id"), "full_outer")
    held_all = F.coalesce("held", F.array().cast(held.schema["held"].dataType))

    def of(kind):
        return F.filter(held_all, lambda x: F.coalesce(x["type"], F.lit("")) == kind)

    others = F.filter(held_all, lambda x: ~F.coalesce(x["type"], F.lit("")).isin("request", "metadata"))
    return both.select(
        F.coalesce("head_id", "capture_id").alias("capture_id"),
        F.coalesce("response.target_uri", "uri").alias("target_uri"),
        F.coalesce("response.date", "at").alias("date"),
        "response",
        of("request").alias("requests"),
        of("metadata").alias("metadata"),
        others.alias("others"),
        (F.size(held_all) + F.col("response").isNotNull().cast("int")).cast("long").alias("n_records"),
    )


RECORDS = "record_id string, type string, target_uri string, date string, content_type string, block binary, concurrent_to array<string>"


def parsed(stream) -> Iterator[dict]:
    """The records of an open, unpacked WARC stream, one after another; what follows a record that breaks off isn't read."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, list[str]] = {}
        last = None
        while (line := stream.readline().rstrip(b"\r\n")):
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and last:  # a folded line
                fields[last][-1] = f"{fields[last][-1]} {text.strip()}".strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields.setdefault(last, []).append(value.strip())
        one = lambda name: fields.get(name, [None])[0]
        size = int(one("content-length") or 0)
        block = stream.read(size)
        if len(block) < size:
            return
        yield {"record_id": one("warc-record-id"), "type": one("warc-type"), "target_uri": (one("warc-target-uri") or "").strip("<>") or None, "date": one("warc-date"), "content_type": one("content-type"), "block": block, "concurrent_to": fields.get("warc-concurrent-to", [])}


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Records of WARC files, plain or gzip, for assemble(): each file is streamed by one task, a record at a time, from any file system that pyarrow knows."""
    if not files:
        return spark.createDataFrame([], RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io

        from pyarrow import fs

        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("block", pa.binary()), ("concurrent_to", pa.list_(pa.string()))])
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(file) if "://" in file or file.startswith("file:") else (fs.LocalFileSystem(), file)
                with system.open_input_stream(path, compression=None) as raw:
                    plain = io.BufferedReader(raw)
                    packed = plain.peek(2)[:2] == b"\x1f\x8b"
                    held, size = [], 0
                    for record in parsed(io.BufferedReader(gzip.GzipFile(fileobj=plain)) if packed else plain):
                        held.append(record)
                        size += len(record["block"])
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    names = spark.createDataFrame(spark.sparkContext.parallelize([(f,) for f in files], len(files)), "file string")
    return names.mapInArrow(run, RECORDS)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Three records for each row of pages, as a crawler would have written them: the page's bytes as the response, the request that asked for it, and metadata, which names the response for http and the request for https. A null page has an empty block and a length of null, a null URL null texts; rows that repeat an id make records that repeat theirs; a page without an id makes records without one; other columns aren't read."""
    page = pages.select(F.col("page_id").cast("string").alias("p"), "url", F.coalesce("html", F.lit("")).alias("html"))
    host, path = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1)
    uid = lambda kind: F.concat(F.lit(f"<urn:{kind}:"), "p", F.lit(">"))
    to_request = F.col("url").startswith("https:")
    request = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    kinds = F.array(
        F.struct(uid("response").alias("record_id"), F.lit("response").alias("type"), F.lit("text/html").alias("content_type"), F.col("html").alias("block"), F.array().cast("array<string>").alias("concurrent_to")),
        F.struct(uid("request").alias("record_id"), F.lit("request").alias("type"), F.lit("application/http").alias("content_type"), request.alias("block"), F.array(uid("response")).alias("concurrent_to")),
        F.struct(uid("metadata").alias("record_id"), F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), F.concat(F.lit("length: "), F.length("html").cast("string")).alias("block"), F.array(F.when(to_request, uid("request")).otherwise(uid("response"))).alias("concurrent_to")),
    )
    return page.select("url", F.explode(kinds).alias("r")).select("r.record_id", "r.type", F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), "r.content_type", "r.block", "r.concurrent_to")


def flat(captures: DataFrame) -> DataFrame:
    """Captures with each nested column as JSON text, so that they can be compared with another engine's."""
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias(c)
    return captures.select("capture_id", "target_uri", "date", text("response"), text("requests"), text("metadata"), text("others"), "n_records")


SQL = """
WITH p AS (
  SELECT page_id::VARCHAR AS p, url, coalesce(html, '') AS html,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages
), records AS (
  SELECT '<urn:response:' || p || '>' AS record_id, 'response' AS type, url AS target_uri, '2024-01-01T00:00:00Z' AS date, 'text/html' AS content_type, html AS block, NULL AS other, []::VARCHAR[] AS concurrent_to FROM p
  UNION ALL SELECT '<urn:request:' || p || '>', 'request', url, '2024-01-01T00:00:00Z', 'application/http', 'GET ' || path || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: ' || host || chr(13) || chr(10) || chr(13) || chr(10), '<urn:response:' || p || '>', ['<urn:response:' || p || '>'] FROM p
  UNION ALL SELECT '<urn:metadata:' || p || '>', 'metadata', url, '2024-01-01T00:00:00Z', 'application/warc-fields', 'length: ' || length(html), CASE WHEN url LIKE 'https:%' THEN '<urn:request:' || p || '>' ELSE '<urn:response:' || p || '>' END, [CASE WHEN url LIKE 'https:%' THEN '<urn:request:' || p || '>' ELSE '<urn:response:' || p || '>' END] FROM p
), placed AS (
  SELECT r.*, coalesce(o.other, r.other) AS capture_id FROM records r LEFT JOIN records o ON r.other = o.record_id WHERE r.type <> 'response'
), held AS (
  SELECT capture_id, count(*) AS n,
    list(struct_pack(record_id := record_id, type := type, target_uri := target_uri, date := date, content_type := content_type, block := block, concurrent_to := concurrent_to) ORDER BY record_id) FILTER (type = 'request') AS requests,
    list(struct_pack(record_id := record_id, type := type, target_uri := target_uri, date := date, content_type := content_type, block := block, concurrent_to := concurrent_to) ORDER BY record_id) FILTER (type = 'metadata') AS metadata
  FROM placed GROUP BY capture_id
)
SELECT h.capture_id, r.target_uri, r.date,
  to_json(struct_pack(record_id := r.record_id, type := r.type, target_uri := r.target_uri, date := r.date, content_type := r.content_type, block := r.block, concurrent_to := r.concurrent_to))::VARCHAR AS response,
  to_json(h.requests)::VARCHAR AS requests, to_json(h.metadata)::VARCHAR AS metadata, '[]' AS others, (h.n + 1)::BIGINT AS n_records
FROM records r JOIN held h ON h.capture_id = r.record_id"""
