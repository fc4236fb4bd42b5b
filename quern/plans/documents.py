"""Corpus queries over documents, pages, benchmark and labels."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus
from .base import register, table, words_sql

ADDRESS, MENTION = rf"https?://[^{tx.BLANK}]+|www\.[^{tx.BLANK}]+", rf"@[{tx.WORD}]+"


def clean_sql(c: str, fold_ya: bool = False) -> str:
    s = tx.strip_sql(f"replace({c}, chr(65279), '')")
    for pattern in (ADDRESS, MENTION, r"[\r\n]+"):
        s = f"regexp_replace({s}, '{pattern}', ' ', 'g')"
    s = rf"regexp_replace({s}, '…+\z', '')"
    if fold_ya:
        s = f"replace({s}, 'ى', 'ي')"
    return tx.strip_sql(f"regexp_replace({s}, '[{tx.BLANK}]{{2,}}', ' ', 'g')")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@register("doc_word_filter", f"SELECT doc_id, len({words_sql('text')})::BIGINT AS n_words FROM documents WHERE text IS NOT NULL AND len({words_sql('text')}) >= 20")
def doc_word_filter(spark, sf_dir):
    return documents(spark, sf_dir).where(corpus.valid_text(F.col("text"))).select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@register("doc_score_filter", f"SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality >= 0.9, true) AND len({words_sql('d.text')}) >= 20")
def doc_score_filter(spark, sf_dir):
    d = documents(spark, sf_dir).where(corpus.valid_text(F.col("text"))).select("doc_id")
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").where(corpus.good_score(F.col("quality")))


@register("doc_clean", f"SELECT doc_id, {clean_sql('text', True)} AS text FROM documents")
def doc_clean(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.clean_document(F.col("text"), True).alias("text"))


@register("page_url_clean", f"SELECT page_id, {clean_sql(chr(39) + 'see ' + chr(39) + ' || url || ' + chr(39) + ' now' + chr(39))} AS text FROM pages")
def page_url_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.clean_document(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("text"))


UNION = f"""raw AS (
  SELECT 0 AS source_rank, 'benchmark' AS source, item_id AS row_ord, {clean_sql('text')} AS text FROM benchmark
  UNION ALL SELECT 1, lang, doc_id, {clean_sql('text')} FROM documents
), ranked AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, row_ord) AS k FROM raw WHERE length(text) >= 20)"""


def _union(spark, sf_dir):
    clean = tx.clean_document(F.col("text")).alias("text")
    b = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("source_rank"), F.lit("benchmark").alias("source"), F.col("item_id").alias("row_ord"), clean)
    return b.unionByName(documents(spark, sf_dir).select(F.lit(1).alias("source_rank"), F.col("lang").alias("source"), F.col("doc_id").alias("row_ord"), clean))


def _first(spark, sf_dir):
    # Equal texts are equally long, so short ones may go once copies are merged; a filter before would clean each text twice, for itself and for the rows that pass.
    return corpus.first_of_each(_union(spark, sf_dir), "text", ["source_rank", "row_ord"]).where(F.length("text") >= corpus.MIN_CHARS)


@register("doc_dedup_first", f"WITH {UNION} SELECT source, row_ord, text FROM ranked WHERE k = 1")
def doc_dedup_first(spark, sf_dir):
    return _first(spark, sf_dir).select("source", "row_ord", "text")


@register("doc_source_counts", f"WITH {UNION} SELECT source, n_raw, coalesce(n_kept, 0) AS n_kept, n_raw - coalesce(n_kept, 0) AS n_dropped, coalesce(n_chars, 0)::BIGINT AS n_chars FROM (SELECT source, count(*) AS n_raw FROM raw GROUP BY source) LEFT JOIN (SELECT source, count(*) AS n_kept, sum(length(text)) AS n_chars FROM ranked WHERE k = 1 GROUP BY source) USING (source)")
def doc_source_counts(spark, sf_dir):
    raw = _union(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_raw"))
    kept = _first(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_kept"), F.sum(F.length("text")).alias("n_chars"))
    return raw.join(kept, "source", "left").select("source", "n_raw", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), (F.col("n_raw") - F.coalesce("n_kept", F.lit(0))).alias("n_dropped"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))


@register("doc_hash_sample", f"SELECT source, count(*) AS n_kept, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE {tx.uniform_sql('doc_id')} < 2147483648 GROUP BY source")
def doc_hash_sample(spark, sf_dir):
    return documents(spark, sf_dir).where(corpus.sampled(F.col("doc_id"))).groupBy("source").agg(F.count("*").alias("n_kept"), F.sum("n_chars").alias("n_chars"))


@register("doc_shard_k_sample", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('67:' || doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 1250")
def doc_shard_k_sample(spark, sf_dir):
    return corpus.at_most_per_group(documents(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", 1250)


VAL_DOCS = 10_000
QUOTA = f"""WITH g AS (SELECT greatest(1, {{total}} // greatest(count(DISTINCT source), 1)) AS quota FROM documents), s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
kept AS (SELECT doc_id, source FROM documents WHERE {tx.uniform_sql('doc_id')} < 2147483648 AND text IS NOT NULL AND len({words_sql('text')}) >= 20),
drawn AS (SELECT k.doc_id, row_number() OVER (PARTITION BY source ORDER BY k.doc_id) AS turn, quota FROM kept k JOIN s USING (source), g
  WHERE {tx.uniform_sql('k.doc_id', 68)} < least(1.0::DOUBLE, quota / greatest(n * 0.5::DOUBLE, 1.0::DOUBLE)) * 4294967296.0::DOUBLE)
SELECT doc_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM drawn WHERE turn <= quota) THEN 'val' ELSE 'train' END AS split FROM kept"""


def _quota(spark, sf_dir, total):
    d = documents(spark, sf_dir)
    keep = corpus.sampled(F.col("doc_id")) & corpus.valid_text(F.col("text"))
    return corpus.validation_quota(d, "source", "doc_id", keep, total, d.select("source").distinct().count()).select("doc_id", "source", "split")


@register("doc_val_quota", QUOTA.replace("{total}", str(VAL_DOCS)))
def doc_val_quota(spark, sf_dir):
    """Kept documents and their split, with the quota of a whole corpus."""
    return _quota(spark, sf_dir, VAL_DOCS)


@register("doc_val_quota_small", QUOTA.replace("{total}", "60"))
def doc_val_quota_small(spark, sf_dir):
    """The same with a quota that documents of a small table exceed."""
    return _quota(spark, sf_dir, 60)


@register("doc_tenth", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('67:' || doc_id::VARCHAR), doc_id) AS k, floor(count(*) OVER () * 0.1::DOUBLE) AS n FROM documents) WHERE k <= n")
def doc_tenth(spark, sf_dir):
    return corpus.exact_sample(documents(spark, sf_dir).select("doc_id"), "doc_id", 0.1)


@register("doc_exact_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('67:' || doc_id::VARCHAR), doc_id) <= ceil(count(*) OVER () * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM documents")
def doc_exact_split(spark, sf_dir):
    return corpus.exact_split(documents(spark, sf_dir).select("doc_id"), "doc_id", 0.1)


@register("doc_halves_in_order", "WITH c AS (SELECT DISTINCT conv_id FROM conversations), h AS (SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY md5('67:' || conv_id::VARCHAR), conv_id) <= floor(count(*) OVER () * 0.5::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM c) SELECT conv_id, row_number() OVER (PARTITION BY split ORDER BY conv_id) AS place, split FROM h")
def doc_halves_in_order(spark, sf_dir):
    """Conversations in two halves, each in its first order."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return corpus.places(corpus.exact_split(c, "conv_id", 0.5, rounding=F.floor), "conv_id").select("conv_id", "place", "split")


@register("doc_weighted_words", f"WITH u AS (SELECT unnest({words_sql('text')}) AS word, 60 AS weight FROM benchmark UNION ALL SELECT unnest({words_sql('text')}), 1 FROM conversations) SELECT word, sum(weight)::BIGINT AS n FROM u GROUP BY word")
def doc_weighted_words(spark, sf_dir):
    """Word counts of several sources of different weights: what a vocabulary is looked for in, without repeating any row."""
    both = corpus.weighted_union([(table(spark, sf_dir, "benchmark").select("text"), 60), (table(spark, sf_dir, "conversations").select("text"), 1)])
    return both.select("weight", F.explode(tx.word_array(F.col("text"))).alias("word")).groupBy("word").agg(F.sum("weight").cast("long").alias("n"))


@register("doc_upsample_union", "SELECT 'benchmark' AS source, item_id AS row_ord, k AS copy_no, length(text) AS n FROM benchmark, generate_series(1, 3) g(k) UNION ALL SELECT source, doc_id, 1, length(text) FROM documents")
def doc_upsample_union(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("row_ord"), F.length("text").cast("long").alias("n"))
    d = documents(spark, sf_dir).select("source", F.col("doc_id").alias("row_ord"), F.length("text").cast("long").alias("n"))
    both = corpus.replicated(b, 3).unionByName(d.withColumn("copy_no", F.lit(1)))
    return both.select("source", "row_ord", F.col("copy_no").cast("long").alias("copy_no"), "n")


@register("doc_arabic_latin_share", "WITH t AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\\x{600}-\\x{6FF}]', '', 'g')) AS n_arabic, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_latin FROM documents) SELECT doc_id, n_arabic, n_latin, n_arabic / greatest(n, 1) AS arabic_share, n_latin > n_arabic AS latin_dominant FROM t")
def doc_arabic_latin_share(spark, sf_dir):
    s = corpus.script_shares(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", *[(v.cast("long") if k.startswith("n_") else v).alias(k) for k, v in s.items()])


@register("doc_nfkc")
def doc_nfkc(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.nfkc("text").alias("text"))


@register("doc_fingerprint", "SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint FROM documents")
def doc_fingerprint(spark, sf_dir):
    from ..sources import fingerprint_of

    return documents(spark, sf_dir).select("doc_id", fingerprint_of(F.col("text")).alias("fingerprint"))


@register("instruct_prompt", "SELECT conv_id, turn, '[inst] ' || text || ' [/inst]' || chr(10) AS prompt FROM conversations WHERE role = 'user'")
def instruct_prompt(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.concat(F.lit("[inst] "), "text", F.lit(" [/inst]\n")).alias("prompt"))


@register("tok_pair_counts", f"WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS word FROM documents) GROUP BY word), p AS (SELECT word, n, unnest(generate_series(1, length(word) - 1)) AS i FROM w WHERE length(word) > 1) SELECT \"left\", \"right\", sum(n)::BIGINT AS n FROM (SELECT substr(word, i, 1) AS \"left\", substr(word, i + 1, 1) AS \"right\", n FROM p) GROUP BY ALL")
def tok_pair_counts(spark, sf_dir):
    return corpus.word_pairs(documents(spark, sf_dir), "text")
