"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from . import lines, minhash, mixing, packing, quality, tokens, toxicity, vectors, warc, wrappers
from .shared import Scratch, table


def op1_warc_transactions(spark, sf_dir):
    """Captures of the pages' records, a row each, nested parts as JSON text. Nulls, repeats and empty tables are as in warc.assemble and warc.records_of_pages."""
    return warc.flat(warc.assemble(warc.records_of_pages(table(spark, sf_dir, "pages"))))


def op2_quality_rules(spark, sf_dir):
    """The documents that are kept, with their scores; nulls, ties and repeats are as in quality.score, and without labels of both classes all documents with words stay."""
    return quality.good_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark, sf_dir):
    """The toxic documents, with their gains; nulls, ties and repeats are as in toxicity.score, and without labels of both classes there are none."""
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embedding_near_dedup(spark, sf_dir):
    """Near copies and the vector of least id that is kept for each; nulls, ties and repeats are as in vectors.near_groups."""
    return vectors.near_groups(table(spark, sf_dir, "embeddings"))


def op5_token_orc(spark, sf_dir):
    """The table of tokens as it is read back; nulls and repeats are as in tokens.write_orc."""
    where = Scratch(spark, "tokens").path("orc")
    tokens.write_orc(table(spark, sf_dir, "documents"), where)
    return tokens.read_orc(spark, where)


def op6_vector_packing(spark, sf_dir):
    """A row for each piece of a conversation; nulls, ties and repeats are as in packing.packed and packing.examples_of_conversations."""
    return packing.packed(packing.examples_of_conversations(table(spark, sf_dir, "conversations")))


def op7_minhash_near_dedup(spark, sf_dir):
    """Near copies and the document of least id that is kept for each; nulls, ties and repeats are as in minhash.near_groups."""
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    """The documents with the lines that stay, and how many went; nulls, ties and repeats are as in lines.drop_repeated_lines."""
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count=True)


def op9_html_wrappers(spark, sf_dir):
    """Fields and text of each page; nulls, ties and repeats are as in wrappers.extract."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op10_mix_to_weights(spark, sf_dir):
    """The documents served, with their finish times; nulls, ties and repeats are as in mixing.schedule."""
    return mixing.schedule(table(spark, sf_dir, "documents"))


def mix_by_words(spark, sf_dir):
    """op10's operator with words for tokens, which SQL can state."""
    return mixing.schedule(table(spark, sf_dir, "documents"), tokenizer=None)


QUERIES = {f.__name__: f for f in (op1_warc_transactions, op2_quality_rules, op3_toxicity, op4_embedding_near_dedup, op5_token_orc, op6_vector_packing, op7_minhash_near_dedup, op8_line_dedup, op9_html_wrappers, op10_mix_to_weights, mix_by_words)}
ORACLE_SQL: dict[str, str] = {"op1_warc_transactions": warc.SQL, "op8_line_dedup": lines.sql(), "mix_by_words": mixing.sql()}
