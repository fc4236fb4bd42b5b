from pyspark.sql import functions as F

from quern.llm import warc


def test_against_sql(same):
    same("op1_warc_transactions")


SCHEMA = "record_id string, type string, target_uri string, date string, content_type string, block string, concurrent_to array<string>, capture_id int, held string"


def rows(spark, *given):
    return spark.createDataFrame([(i, t, u, "d", "c", b, to, 1, "clash") for i, t, u, b, to in given], SCHEMA)


def shape(df):
    return sorted((r.capture_id, r.response.record_id if r.response else None, [x.record_id for x in r.requests], [x.record_id for x in r.metadata], [x.record_id for x in r.others], r.n_records) for r in df.collect())


def test_chains_either_direction_and_nearest_response(spark):
    got = shape(
        warc.assemble(
            rows(
                spark,
                ("r1", "response", "u1", "x", None),
                ("r2", "response", "u2", "x", ["q2"]),
                ("q1", "request", "u1", "x", ["r1"]),
                ("q2", "request", "u2", "x", []),
                ("m1", "metadata", "u1", "x", ["q1"]),
                ("m1b", "metadata", "u1", "x", ["m1"]),
                ("m2", "metadata", "u2", "x", ["r1", "r2"]),
                ("far", "metadata", "u2", "x", ["m2", "q2"]),
                ("v", "revisit", "u3", None, ["nowhere"]),
            )
        )
    )
    assert got == [("r1", "r1", ["q1"], ["far", "m1", "m1b", "m2"], [], 6), ("r2", "r2", ["q2"], [], [], 2), ("v", "v", [], [], [], 1)]


def test_edge_cases(spark):
    long = "y" * 2_000_000
    given = rows(
        spark,
        ("r", "response", None, long, ["r", None]),
        ("r", "response", None, long, ["r", None]),
        (None, "request", "u", "", ["r"]),
        ("a", "request", "u", None, ["b"]),
        ("b", "metadata", "t", None, ["c"]),
        ("c", None, "t", None, None),
        ("z", "warcinfo", None, None, []),
    )
    got = warc.assemble(given)
    found = shape(got)
    assert found[0] == ("a", None, ["a"], ["b"], ["c"], 3)
    assert found[1][:2] == ("r", "r") and len(found[1][2]) == 1 and found[1][5] == 2
    assert found[2] == ("z", None, [], [], ["z"], 1)
    assert {r.capture_id: r.target_uri for r in got.collect()} == {"a": "t", "r": "u", "z": None}
    assert warc.assemble(given.where("false")).collect() == []


def test_files_are_read_record_by_record(spark, tmp_path):
    import gzip

    def record(kind, name, block, *more):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + name + b">", b"WARC-Date: 2024-01-01T00:00:00Z", b"Content-Length: %d" % len(block), *more]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    body = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0 in a body\r\n\xff\x00" + b"x" * 3_000_000
    records = [record(b"warcinfo", b"i", b"software: x"), record(b"response", b"r", body, b"WARC-Target-URI: http://a/"), record(b"request", b"q", b"GET /", b"WARC-Concurrent-To: <r>", b"WARC-Concurrent-To:", b"  <i>"), record(b"metadata", b"m", b"", b"WARC-Concurrent-To: <q>")]
    plain, packed, cut = tmp_path / "a.warc", tmp_path / "b.warc.gz", tmp_path / "c.warc"
    plain.write_bytes(b"".join(records))
    packed.write_bytes(b"".join(gzip.compress(r) for r in records))
    cut.write_bytes(records[0] + records[1][:2000])
    for file in (plain, packed):
        got = warc.read_files(spark, [str(file)]).collect()
        assert [(r.type, r.record_id, r.concurrent_to) for r in got] == [("warcinfo", "<i>", []), ("response", "<r>", []), ("request", "<q>", ["<r>", "<i>"]), ("metadata", "<m>", ["<q>"])]
        assert bytes(got[1].block) == body and got[1].target_uri == "http://a/"
    assert [r.type for r in warc.read_files(spark, [cut.as_uri()]).collect()] == ["warcinfo"]
    assert warc.read_files(spark, []).collect() == []
    found = [r for r in warc.assemble(warc.read_files(spark, [str(packed)])).collect()]
    assert [(r.capture_id, [x.record_id for x in r.requests], [x.record_id for x in r.metadata], r.n_records) for r in found if r.response] == [("<r>", ["<q>"], ["<m>"], 4)]
    assert found[0].requests[0].concurrent_to == ["<r>", "<i>"]
