"""Line dedup: levelled sorted runs of line hashes; each batch merge-anti-joins the runs and adds its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

LAST = (1 << 63) - 1


class Runs:
    """Line hashes seen so far: tables bucketed and sorted by hash, so that a batch is merged with each run without moving the run. Level k holds fewer than `fanout` runs; when it has that many, they become one run of level k + 1. No hash is in two runs."""

    def __init__(self, scratch: Scratch, buckets: int, fanout: int):
        self.scratch, self.spark, self.buckets, self.fanout = scratch, scratch.spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{self.made}"
        self.made += 1
        table = self._table(name)
        rows.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", self.scratch.path(name)).saveAsTable(table)
        return name

    def _table(self, name: str) -> str:
        return f"{self.scratch.root.rsplit('/', 1)[1].replace('-', '_')}_{name}"

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self._table(name)}")
        self.scratch.drop(name)

    def add(self, heads: DataFrame) -> str:
        """Of heads (h, win), those with a hash that no run has, as a run of level 0; its name."""
        for level in self.levels:
            for name in level:
                heads = heads.join(self.spark.table(self._table(name)).select("h").hint("merge"), "h", "left_anti")
        name = self._write(heads)
        self._put(name, 0)
        return name

    def _put(self, name: str, at: int) -> None:
        if at == len(self.levels):
            self.levels.append([])
        self.levels[at].append(name)

    def compact(self) -> None:
        """Merges every level that is full; called between batches, when none of its runs is read."""
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fanout:
                old, self.levels[at] = self.levels[at], []
                merged = self.spark.table(self._table(old[0]))
                for name in old[1:]:
                    merged = merged.unionByName(self.spark.table(self._table(name)))
                self._put(self._write(merged.repartition(self.buckets, "h")), at + 1)
                for name in old:
                    self._forget(name)
            at += 1

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self._forget(name)
        self.levels = []


def _sum(parts: list[Column]) -> Column:
    """Their sum, halved again and again, so that the expression isn't deep."""
    if len(parts) < 2:
        return parts[0] if parts else F.lit(0)
    return _sum(parts[: len(parts) // 2]) + _sum(parts[len(parts) // 2 :])


def _key(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


#: What is taken off a line's ends before it is compared.
ENDS = " \t\r\x0b\x0c\u00a0"


def repeated_lines(docs: DataFrame, scratch: Scratch, batches: int | None, min_chars: int, fanout: int, batch_docs: int) -> DataFrame:
    """(id, key, at): for each document the positions of its lines that are to go; documents without one have no row."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text")
    batches = batches or max(4, -(-slim.count() // batch_docs))
    # The batches are ranges of ids in order, so it doesn't matter where they are cut.
    share = [k / batches for k in range(1, batches)]
    cuts = sorted({*(slim.agg(F.percentile_approx("id", share, 10 * batches + 1000).alias("c")).first().c or []), LAST}) if share else [LAST]
    batch = _sum([(F.col("id") > cut).cast("int") for cut in cuts[:-1]])
    lines = slim.select("id", _key(F.col("text")).alias("key"), batch.alias("batch"), F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", F.btrim("line", F.lit(ENDS))).where(F.length("line") >= max(1, min_chars))
    lines.select("id", "key", "batch", "no", F.unhex(F.md5("line")).alias("h")).write.partitionBy("batch").parquet(scratch.path("lines"))
    schema = "id long, key long, no int, h binary, batch int"
    saved = spark.read.schema(schema).parquet(scratch.path("lines"))
    runs = Runs(scratch, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    try:
        for k in range(len(cuts)):
            part = saved.where(F.col("batch") == k)
            heads = part.groupBy("h").agg(F.min(F.struct("id", "key", "no")).alias("win"))
            name = runs.add(heads)
            # Read by path, not as a bucketed table: AQE can then split a hot line's rows.
            new = spark.read.schema(heads.schema).parquet(scratch.path(name))
            gone = part.join(new, "h", "left").where(F.col("win").isNull() | (F.struct("id", "key", "no") != F.col("win")))
            gone.select("id", "key", "no").write.parquet(scratch.path(f"lost/batch={k}"))
            runs.compact()
    finally:
        runs.drop()
    scratch.drop("lines")
    lost = spark.read.schema("id long, key long, no int, batch int").parquet(scratch.path("lost"))
    return lost.groupBy("id", "key").agg(F.collect_set("no").alias("at"))


def drop_repeated_lines(docs: DataFrame, batches: int | None = None, min_chars: int = 1, fanout: int = 2, count: bool = False, batch_docs: int = 50_000_000) -> DataFrame:
    """docs with only the first occurrence of each line, first by (doc_id, line number), over the whole corpus.

    Lines are parted by line feeds and compared without the blanks, tabs and carriage returns at their ends, by their
    whole MD5, whatever their length; blank lines, and those of fewer than min_chars characters if that is set, always
    stay. A document that lost lines and has nothing but blanks left goes; any other stays,
    with the remaining lines in order and n_chars, if there is such a column, as their length. A null text stays null
    and an empty one empty. Documents without an id come last. Rows with the same id and text are one document:
    they all keep the same lines; of rows with one id and different texts the one of least text hash comes first.
    `count` adds a column n_dropped. Without `batches` there are as many as hold batch_docs documents each, 4 at
    least, so what a batch moves doesn't grow with the corpus.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = repeated_lines(docs, scratch, batches, min_chars, fanout, batch_docs)
    gone = gone.select(F.col("id").alias("__q_id"), F.col("key").alias("__q_key"), F.col("at").alias("__q_at"))
    keyed = docs.withColumns({"__q_own": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__q_text": _key(F.col("text"))})
    both = keyed.join(gone, (F.col("__q_own") == F.col("__q_id")) & (F.col("__q_text") == F.col("__q_key")), "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__q_at")
    # Split once a row, not once a line.
    left = F.transform(F.array(F.struct(lines.alias("l"), stay.alias("s"))), lambda x: F.array_join(F.transform(x["s"], lambda i: F.get(x["l"], i)), "\n"))[0]
    both = both.withColumn("text", F.when(F.col("__q_at").isNull(), F.col("text")).otherwise(left))
    both = both.where(F.col("__q_at").isNull() | (F.btrim("text", F.lit(ENDS + "\n")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        both = both.withColumn("n_chars", F.when(F.col("__q_at").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    extra = [F.coalesce(F.size("__q_at"), F.lit(0)).cast("long").alias("n_dropped")] if count else []
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], *extra)


def sql(min_chars: int = 1) -> str:
    ends = "' ' || chr(9) || chr(13) || chr(11) || chr(12) || chr(160)"
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents WHERE text IS NOT NULL
), ranked AS (
  SELECT *, length(trim(line, {ends})) >= {max(1, min_chars)} AND row_number() OVER (PARTITION BY trim(line, {ends}) ORDER BY doc_id, no) > 1 AS gone FROM lines
), rebuilt AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone) AS text, count(*) FILTER (gone) AS n_dropped FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN r.n_dropped > 0 THEN r.text ELSE d.text END AS text, coalesce(r.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
WHERE coalesce(r.n_dropped, 0) = 0 OR trim(coalesce(r.text, ''), {ends} || chr(10)) <> ''"""
