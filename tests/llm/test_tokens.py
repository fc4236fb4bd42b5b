import glob

from pyspark.sql import functions as F

from quern.llm import tokens


def test_round_trip_and_stripes(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy(F.rand(1))
    where = str(tmp_path / "t")
    tokens.write_orc(docs, where, stripe_bytes=1 << 16, index_rows=1000)
    got = {r.doc_id: r.tokens for r in tokens.read_orc(spark, where).collect()}
    encoding = tokens._encoding(tokens.TOKENIZER)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {i: encoding.decode(t) for i, t in got.items()} == texts
    parts = tokens.stripes(spark, where)
    assert len(parts) > len(glob.glob(f"{where}/*.orc"))
    seen = []
    for p in parts:
        ids = tokens.read_stripe(p["file"], p["stripe"]).column("doc_id").to_pylist()
        assert ids == sorted(ids) and (len(ids), ids[0], ids[-1]) == (p["rows"], p["low"], p["high"])
        seen += ids
    assert sorted(seen) == sorted(texts)
    # Whatever order the corpus lay in, the stripes' ranges follow each other.
    ranges = sorted((p["low"], p["high"]) for p in parts)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    whole = tokens.read_stripes(spark, where)
    assert whole.rdd.getNumPartitions() == len(parts) and {r.doc_id: r.tokens for r in whole.collect()} == got
    some = [seen[5], seen[-1], -7]
    few = tokens.read_stripes(spark, where, some)
    assert few.rdd.getNumPartitions() <= 2 and sorted(r.doc_id for r in few.collect()) == sorted(some[:2])


def index_of(spark, file):
    """(least, greatest, Bloom filter) of doc_id of each row group of the first stripe, as the format's own reader gives them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    columns = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
    for k in range(len(columns)):
        columns[k] = True
    index = reader.rows().readRowIndex(0, columns, columns)
    blooms = index.getBloomFilterIndex()[1]
    kind = index.getBloomFilterKinds()[1]
    out = []
    for k, entry in enumerate(index.getRowGroupIndex()[1].getEntryList()):
        s = entry.getStatistics().getIntStatistics()
        bloom = jvm.org.apache.orc.util.BloomFilterIO.deserialize(kind, reader.getSchema().findSubtype("doc_id") and jvm.org.apache.orc.OrcProto.ColumnEncoding.newBuilder().setKind(jvm.org.apache.orc.OrcProto.ColumnEncoding.Kind.DIRECT_V2).setBloomEncoding(1).build(), reader.getWriterVersion(), jvm.org.apache.orc.TypeDescription.Category.LONG, blooms.getBloomFilter(k))
        out.append((s.getMinimum(), s.getMaximum(), bloom))
    return out


def test_ids_are_looked_up_through_the_index(spark, tmp_path):
    docs = spark.range(200000).select((F.col("id") * 2).alias("doc_id"), F.lit("a b").alias("text"))
    where = str(tmp_path / "t")
    tokens.write_orc(docs, where, stripe_bytes=1 << 16)
    found = tokens.read_orc(spark, where, [7, 1000, 399998])
    assert sorted(r.doc_id for r in found.collect()) == [1000, 399998]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    assert tokens.read_orc(spark, where, [299999]).count() == 0

    # Row groups of 1,000 rows, with ranges that follow each other and Bloom filters that hold their ids and hardly any odd one.
    groups = index_of(spark, sorted(glob.glob(f"{where}/*.orc"))[0])
    assert len(groups) > 1 and all(a[1] < b[0] for a, b in zip(groups, groups[1:]))
    low, high, bloom = groups[0]
    assert high - low == 1998
    assert all(bloom.testLong(i) for i in range(low, high + 1, 2))
    assert sum(bloom.testLong(i) for i in range(low + 1, high, 2)) < 50


def test_long_text_is_cut_where_no_token_spans():
    text = "some words, and 12 numbers  here\n" * 9 + "word " * 100000 + "x" * 300000 + " tail of it"
    encoding = tokens._encoding(tokens.TOKENIZER)
    parts = list(tokens.pieces(text))
    assert "".join(parts) == text and len(parts) > 2
    small = text[:400_000]
    assert tokens.encode([small], tokens.TOKENIZER)[0].tolist() == encoding.encode_ordinary(small)


def test_edge_cases(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same")], "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    tokens.write_orc(docs.coalesce(1), str(tmp_path / "a"))
    got = sorted(((r.doc_id, r.n_tokens, r.tokens) for r in tokens.read_orc(spark, str(tmp_path / "a")).collect()), key=str)
    one = tokens.encode(["same", "no id"], tokens.TOKENIZER)
    assert got == sorted([(1, None, None), (2, 0, []), (None, len(one[1]), one[1].tolist()), (3, len(one[0]), one[0].tolist()), (3, len(one[0]), one[0].tolist())], key=str)
    tokens.write_orc(docs.where("false"), str(tmp_path / "b"))
    assert tokens.read_orc(spark, str(tmp_path / "b")).collect() == []
