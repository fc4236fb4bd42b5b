"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORDS_SQL, Scratch, words_count
from .tokens import TOKENIZER, counted

WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}


def _weight(source: Column, weights: dict[str, float], other: float) -> Column:
    at = F.lit(float(other))
    for name, w in weights.items():
        at = F.when(source == name, F.lit(float(w))).otherwise(at)
    return at


def shuffle_key(seed: int) -> Column:
    """A document's place in its source's shuffled order: the MD5 of the seed, the id and the text's MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def schedule(docs: DataFrame, weights: dict[str, float] = WEIGHTS, other: float = 1.0, share: float = 0.6, seed: int = 1, bucket_rows: int = 50_000, tokenizer: str | None = TOKENIZER, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, source, key, n_tokens, finish, served): the kept documents, range-sorted by virtual finish time.

    A source's documents stand in shuffled order. The finish time of a document is the sum of its source's tokens
    up to it and with it, over the source's weight; served is the sum of tokens in order of (finish, source,
    key), so equal finish times are ordered by source and key. Tokens are those of the whole text by the file
    `tokenizer`; None counts words instead. Documents stay while served is within `share` of all tokens of sources with a weight above 0; the first
    that would exceed it ends the mix. Sources that aren't named have the weight `other`; a null source counts as ''.
    Rows with the same source, id and text are one unit with the sum of their tokens; a null or empty text has none.

    Neither sum is taken in one task: a source is cut into buckets by the first digits of the key, as many as its
    size asks for, and the finish times into ranges; each needs only the sums of those before it.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), shuffle_key(seed).alias("key"), "text")
    units = units.withColumn("weight", _weight(F.col("source"), weights, other)).where("weight > 0")
    units = counted(units, tokenizer) if tokenizer else units.withColumn("n", words_count(F.col("text"))).drop("text")
    units = scratch.save(units.groupBy("source", "key", "weight").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens")), "units")
    size = units.agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens")).first()
    digits = 1
    while size.rows / 16**digits > bucket_rows:
        digits += 1
    cut = units.withColumn("bucket", F.substring("key", 1, digits))
    sums = cut.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    timed = cut.withColumn("run", F.sum("n_tokens").over(inside)).join(sums, ["source", "bucket"])
    timed = timed.select("doc_id", "source", "key", "n_tokens", ((F.col("start") + F.col("run")).cast("double") / F.col("weight")).alias("finish"))

    order = ["finish", "source", "key"]
    ranged = scratch.save(timed.orderBy(*order).withColumn("range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("range").agg(F.sum("n_tokens").alias("sum"))
    # One row a range.
    totals = totals.select("range", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    run = F.sum("n_tokens").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    budget = int(share * (size.tokens or 0))
    return ranged.withColumn("run", run).join(totals, "range").withColumn("served", F.col("start") + F.col("run")).where(F.col("served") <= budget).select("doc_id", *order[1:], "n_tokens", "finish", "served")


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that schedule() keeps, all columns as they were; nulls, ties, repeated rows and empty tables are as there. A source's kept documents are the first of its shuffled order, so the last kept key of each source tells which rows stay, and no text is moved."""
    scratch = Scratch(docs.sparkSession, "mixing")
    seed = params.get("seed", 1)
    last = scratch.save(schedule(docs, scratch=scratch, **params).groupBy("source").agg(F.max("key").alias("last")), "last")
    last = last.select(F.col("source").alias("__q_source"), F.col("last").alias("__q_last"))
    keyed = docs.withColumns({"__q_own": F.coalesce(F.col("source").cast("string"), F.lit("")), "__q_key": shuffle_key(seed)})
    kept = keyed.join(last, (F.col("__q_own") == F.col("__q_source")) & (F.col("__q_key") <= F.col("__q_last")), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def sql(weights: dict[str, float] = WEIGHTS, other: float = 1.0, share: float = 0.6, seed: int = 1) -> str:
    """The rows of schedule() with words for tokens; a vocabulary has no SQL form."""
    cases = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in weights.items())
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS source, {WORDS_SQL.format(text="text")} AS n_tokens,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), f AS (
  SELECT *, (sum(n_tokens) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING))::DOUBLE
    / (CASE source {cases} ELSE {float(other)} END)::DOUBLE AS finish
  FROM t
), c AS (
  SELECT *, (sum(n_tokens) OVER (ORDER BY finish, source, key ROWS UNBOUNDED PRECEDING))::BIGINT AS served FROM f
)
SELECT doc_id, source, key, n_tokens, finish, served FROM c
WHERE served <= (SELECT floor({share}::DOUBLE * sum(n_tokens)) FROM t)"""
