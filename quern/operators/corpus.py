"""Documents: filters, samples, splits, first-wins dedup, replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

MIN_WORDS, MIN_SCORE, KEEP, MIN_CHARS = 20, 0.9, 0.5, 20


def valid_text(c: Column, min_words: int = MIN_WORDS) -> Column:
    return c.isNotNull() & (tx.word_count(c) >= min_words)


def good_score(c: Column, least: float = MIN_SCORE) -> Column:
    """A document without a score stays."""
    return F.coalesce(c >= least, F.lit(True))


def sampled(key: Column, share: float = KEEP, seed: int = 67) -> Column:
    return tx.uniform(key, seed) < F.lit(int(share * 2**32))


def first_of_each(docs: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each text by the order: one that says which source wins. A group-by on 16 bytes of hash, so copies are merged before they are moved and keys are short."""
    rest = [c for c in docs.columns if c not in order]
    top = F.min(F.struct(*order, *rest)).alias("top")
    return docs.groupBy(F.unhex(F.md5(text)).alias("__h")).agg(top).select(*[F.col(f"top.{c}").alias(c) for c in docs.columns])


def at_most_per_group(docs: DataFrame, group: str, key: str, k: int, seed: int = 67) -> DataFrame:
    w = Window.partitionBy(group).orderBy(tx.shuffle_order(F.col(key), seed), key)
    return docs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def validation_quota(docs: DataFrame, group: str, key: str, keep: Column, total: int, n_groups: int, seed: int = 67) -> DataFrame:
    """The rows of docs that `keep` holds for, with split: of each group at most total / n_groups of them, and one at least may be, are 'val'.

    Kept rows are drawn at a rate that makes the quota of half of the group's rows, by a draw of their own, and of those drawn the
    first by key stay: so 'val' comes from all over a group. Only drawn rows, about `total` in all, are put in order.
    """
    quota = max(1, total // max(1, n_groups))
    sizes = docs.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__size"))
    kept = docs.where(keep)
    rate = F.least(F.lit(1.0), quota / F.greatest(F.col("__size") * KEEP, F.lit(1.0)))
    drawn = kept.select(F.col(group).alias("__of"), F.col(key).alias("__k")).join(sizes, F.col("__of").eqNullSafe(F.col("__g"))).where(tx.uniform(F.col("__k"), seed + 1) < rate * float(2**32))
    turn = F.row_number().over(Window.partitionBy("__g").orderBy("__k"))
    val = drawn.withColumn("__turn", turn).where(F.col("__turn") <= quota).select("__k", F.lit("val").alias("__split"))
    return kept.join(val, F.col(key) == F.col("__k"), "left").withColumn("split", F.coalesce("__split", F.lit("train"))).drop("__k", "__split")


def exact_split(docs: DataFrame, key: str, fraction: float, seed: int = 67, rounding=F.ceil) -> DataFrame:
    """Adds split: exactly fraction * n rows, rounded up or as told, are 'test', those of least hash.

    The boundary is found in two steps, so nothing is ranked in one task: counts of 65,536 ranges of the hash tell the range
    that the boundary lies in, and only its rows are ranked.
    """
    at = tx.shuffle_order(F.col(key), seed)
    cells = docs.groupBy(F.substring(at, 1, 4).alias("cell")).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("upto", run).withColumn("want", rounding(F.sum("n").over(Window.partitionBy()) * F.lit(fraction)))
    # One row.
    edge = cells.where("upto >= want").agg(F.min(F.struct("cell", (F.col("want") - F.col("upto") + F.col("n")).alias("left"))).alias("e")).select("e.cell", "e.left").first()
    cell, left = (edge.cell or "", edge.left or 0) if edge else ("", 0)
    inside = docs.select(F.col(key).alias("__k"), at.alias("__at")).where(F.substring("__at", 1, 4) == cell)
    picked = inside.withColumn("__r", F.row_number().over(Window.orderBy("__at", "__k"))).where(F.col("__r") <= left).select("__k", F.lit(True).alias("__hit"))
    flagged = docs.join(picked, F.col(key) == F.col("__k"), "left")
    return flagged.withColumn("split", F.when((F.substring(at, 1, 4) < cell) | F.col("__hit"), "test").otherwise("train")).select(*docs.columns, "split")


def exact_sample(docs: DataFrame, key: str, fraction: float, seed: int = 67) -> DataFrame:
    """floor(fraction * n) rows without replacement, those of least hash."""
    return exact_split(docs, key, fraction, seed, F.floor).where("split = 'test'").drop("split")


def places(halves: DataFrame, order: str) -> DataFrame:
    """Adds place, from 1: a row's position among those of its split ('test' or not), by an order that is a number and unique."""
    from .blocks import offsets

    counted = halves.withColumn("__one", F.lit(1).cast("long")).withColumn("__test", (F.col("split") == "test").cast("long"))
    both = offsets(counted, order, "__one").withColumnRenamed("start", "__all")
    both = offsets(both, order, "__test")
    place = F.when(F.col("split") == "test", F.col("start")).otherwise(F.col("__all") - F.col("start")) + 1
    return both.withColumn("place", place).drop("__one", "__test", "__all", "start")


def replicated(docs: DataFrame, times: Column | int) -> DataFrame:
    n = F.lit(times) if isinstance(times, int) else times
    return docs.withColumn("copy_no", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))))


def weighted_union(sources: list[tuple[DataFrame, int]]) -> DataFrame:
    """(source_rank, weight, ...): sources one after another, each row with the number of times that it counts. What only counts multiplies by the weight; replicated() repeats rows for what reads them."""
    out = None
    for rank, (rows, weight) in enumerate(sources):
        part = rows.withColumns({"source_rank": F.lit(rank), "weight": F.lit(weight)})
        out = part if out is None else out.unionByName(part)
    return out


def script_shares(c: Column) -> dict[str, Column]:
    arabic, latin = F.regexp_count(c, F.lit(r"[\x{600}-\x{6FF}]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return {"n_arabic": arabic, "n_latin": latin, "arabic_share": arabic / F.greatest(F.length(c), F.lit(1)), "latin_dominant": latin > arabic}


def word_pairs(docs: DataFrame, text: str) -> DataFrame:
    """(left, right, n): counts of neighbouring characters in words, each word weighed by its count: the aggregate that a merge table is chosen from. Words are counted first, so pairs come from distinct words."""
    words = docs.select(F.explode(tx.word_array(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    at = F.posexplode(F.split("word", "")).alias("i", "left")
    letters = words.where(F.length("word") > 1).select("word", "n", at)
    pairs = letters.where(F.col("i") < F.length("word") - 1).withColumn("right", F.substring(F.col("word"), F.col("i") + 2, F.lit(1)))
    return pairs.groupBy("left", "right").agg(F.sum("n").alias("n"))
