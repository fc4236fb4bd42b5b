"""A corpus pipeline over documents: quality rules, line dedup, near-dedup, mixing to weights, packing.

Each stage takes (spark, docs, sf_dir) and gets the rows that the one before it left, read again from Parquet; all but
the last return the columns of documents.
"""

from __future__ import annotations

from quern.llm import lines, minhash, mixing, packing, quality
from quern.llm.shared import Scratch, table


def quality_rules(spark, docs, sf_dir):
    """Documents that the boosted trees reject go, and with them null and empty texts and those without words. Rows that repeat are judged alike, ids aren't looked at, and an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Lines that an earlier document has go; documents of nothing else go with them. Documents without an id come last; null and empty texts stay; rows with one id and text keep the same lines."""
    return lines.drop_repeated_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays, that of least id; rows without an id come after those with one, and null and empty texts are no copies."""
    return minhash.drop_near_copies(docs)


def mix_to_weights(spark, docs, sf_dir):
    """Documents that are served within the budget of tokens stay. A null source is a source of its own, a null or empty text has no tokens, rows with one source, id and text stay or go together."""
    return mixing.mixed(docs)


def pack(spark, docs, sf_dir):
    """A row for each piece of a document: its bin and its place in it. Every token of a document bears loss, so the limits on tokens and on loss coincide. Texts without tokens have no row; rows that repeat, and rows without an id, are placed each."""
    placed = packing.packed(packing.examples_of_documents(docs), limits=(2048, 16, 2048))
    return placed.withColumnRenamed("example_id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mix_to_weights", mix_to_weights),
    ("vector_packing", pack),
]

#: Trees, near copies and greedy packing have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The result of the last stage over the documents of sf_dir. A stage's table goes once the next one's is written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
