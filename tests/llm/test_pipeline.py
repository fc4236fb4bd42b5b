from collections import defaultdict

import numpy as np

import corpus_pipeline as cp
from quern.llm import mixing, quality
from quern.llm.shared import Scratch
from quern.llm.tokens import TOKENIZER, encode

from test_lines import brute as plain_lines
from test_mixing import brute as plain_mix
from test_minhash import brute as plain_groups


def test_each_stage_against_a_plain_version_of_it(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, rows, seen = Scratch(spark, "test"), {}, [docs.columns]
    for name, f in cp.STAGES:
        rows[name, 0] = docs.collect()
        docs = scratch.save(f(spark, docs, sf_dir), name)
        rows[name, 1] = docs.collect()
        seen.append(docs.columns)
    assert all(c == seen[0] for c in seen[:-1])

    before, after = rows["quality_rules", 0], rows["quality_rules", 1]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in quality.good_documents(spark.createDataFrame(before), labels).collect()}
    assert {r.doc_id for r in after} == good and 0 < len(after) < len(before)
    label = {r.doc_id: r.quality for r in labels.collect()}
    clean = [r.doc_id in good for r in before if label.get(r.doc_id) == 1]
    assert sum(clean) >= 0.95 * len(clean)

    before, after = rows["line_dedup", 0], rows["line_dedup", 1]
    assert sorted((r.doc_id, r.text) for r in after) == sorted(plain_lines([(r.doc_id, r.text) for r in before]))
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = rows["minhash_near_dedup", 0], rows["minhash_near_dedup", 1]
    copies = plain_groups([(r.doc_id, r.text) for r in before])
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone <= set(copies) and len(gone) >= 0.9 * len(copies)

    before, after = rows["mix_to_weights", 0], rows["mix_to_weights", 1]
    assert {r.doc_id for r in after} == {r[0] for r in plain_mix([(r.doc_id, r.text, r.source) for r in before], mixing.WEIGHTS, 0.6)}

    before, after = rows["vector_packing", 0], rows["vector_packing", 1]
    tokens = {r.doc_id: len(encode([r.text], TOKENIZER)[0]) for r in before}
    got, bins = defaultdict(int), defaultdict(lambda: np.zeros(3, int))
    for r in after:
        got[r.doc_id] += r.n_tokens
        bins[r.bin_id] += [r.n_tokens, 1, r.n_loss]
    assert got == {k: v for k, v in tokens.items() if v}
    assert all((b <= (2048, 16, 2048)).all() for b in bins.values())


def test_empty_documents(spark, sf_dir, tmp_path):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for k, (_, f) in enumerate(cp.STAGES):
        out = f(spark, empty, sf_dir)
        assert out.collect() == []
        empty = empty if k == len(cp.STAGES) - 1 else out.where("false")


def test_odd_rows_go_through_every_stage(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "no id here but words enough to stay around", "en", None, 5), (900001, None, None, "src1", None), (900002, "", "en", "src1", 0), (900003, "word " * 60000, "en", "src1", 300000)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(5)).withColumns({"h": F.lit(1), "label": F.lit("x"), "weight": F.lit(2), "score": F.lit("y"), "keep": F.lit(0)})
    scratch = Scratch(spark, "odd")
    for name, f in cp.STAGES:
        out = scratch.save(f(spark, docs, sf_dir), name)
        assert name == "vector_packing" or out.columns == docs.columns
        assert out.count() > 0
        docs = out
