import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from orrery.llm import common as C
from orrery.llm import exact_dedup as E
from orrery.llm import warc as A

DOCS = "doc_id long, text string, keep_id string, _run int, _sha string"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_equals_brute_force_whatever_the_rounds(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "A", "É", "é", "x" * 200_000, "X" * 200_000, " a", "a\n"]
    rows = [(k, rng.choice(texts), "clash", 1, "clash") for k in range(60)] + [(100 + k, "hot", "", 0, "") for k in range(40)] + [(7, "a", "", 0, ""), (7, "a", "", 0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(fold(t), []).append(i)
    want = sorted((i, max(groups[fold(t)]), len(groups[fold(t)]), i == max(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t, *_ in rows)
    for how in ({}, {"fan_in": 2, "rows_per_run": 5}):
        got = sorted(tuple(r) for r in E.exact_dedup(docs, **how).collect())
        assert got == want
    kept = E.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (None, "b")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_dedup(docs).collect()), key=repr)
    assert got == sorted([(0, None, 2, True), (0, None, 2, True), (1, 1, 2, True), (0, 1, 2, False)], key=repr)
    assert E.exact_dedup(docs.limit(0)).count() == 0 and E.deduplicated(docs.limit(0)).count() == 0


def test_equal_digests_with_unequal_checks_stay_apart(spark):
    rows = spark.createDataFrame([(1, b"s", 3, 1), (2, b"s", 3, 2), (3, b"s", 3, 1)], "_id long, _sha binary, _size long, _check long")
    got = {r["_id"]: (r["_keep"], r["_group"]) for r in E.tree_merge(rows, ["_sha", "_size", "_check"]).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_every_level_merges_in_sorted_order(spark):
    entries = spark.range(50).selectExpr("id AS _id", "sha2(string(id % 7), 256) AS _sha", "id % 7 + 1 AS _size", "id % 7 AS _check")
    plan = E.tree_merge(entries, ["_sha", "_size", "_check"], fan_in=2, rows_per_run=10)._jdf.queryExecution().executedPlan().toString()
    # One merge for the leaves and one for each of three rounds, each over sorted rows; what hashes lists digests only.
    lines = plan.splitlines()
    assert all("functions=[]" in x for x in lines if "HashAggregate" in x)
    assert any("SortAggregate(key=[_run#" in x and "_slice#" not in x.split("functions")[0] for x in lines)
    assert len([x for x in lines if "Sort [_run#" in x and "_slice#" in x]) == len([x for x in lines if "Exchange hashpartitioning(_run#" in x and "_slice#" in x]) == 3


def test_records_in_any_pieces():
    body = b"<html>\r\n\r\n" + bytes(range(256)) * 50
    data = A.record(5, "http://x/é y", body) + A.record(6, None, body, refers_to=5) + A.record(7, "u", b"")
    assert gzip.decompress(data).count(b"WARC/1.1") == 3
    for size in (1, 7, 1000, 10**6):
        pieces = iter([data[k : k + size] for k in range(0, len(data), size)])
        one, two, three = (A.read_record(m) for m in A.members(pieces))
        assert (one["kind"], one["payload"], one["payload_bytes"]) == ("response", body, len(body))
        assert (two["kind"], two["payload"], two["payload_bytes"], two["payload_sha1"]) == ("revisit", None, len(body), one["payload_sha1"])
        assert three["payload"] == b"" and one["payload_sha1"] == hashlib.sha1(body).hexdigest()


def test_broken_archives_are_refused():
    data = A.record(5, "u", b"hello")

    def read(raw):
        return [A.read_record(m) for m in A.members(iter([raw]))]

    for raw in (data[:-9], b"plain", zlib_member(gzip.decompress(data).replace(b"hello", b"hallo")), zlib_member(gzip.decompress(data).replace(b"Content-Length: ", b"Content-Length: 9", 1)), zlib_member(gzip.decompress(data)[:-1])):
        with pytest.raises(A.WarcError):
            read(raw)


def test_small_pieces_that_inflate_to_much_are_taken_bit_by_bit():
    body = bytes(50 << 20)
    data = A.record(5, "u", body)
    assert len(data) < A.READ_BYTES
    sizes = [len(x) for m in A.members(iter([data])) for x in m]
    assert max(sizes) <= A.READ_BYTES and sum(sizes) > len(body)
    assert A.read_record(next(A.members(iter([data]))), with_payload=False)["payload_sha1"] == hashlib.sha1(body).hexdigest()
    for raw in (b"WARC/1.1\r\n" + b"x" * (3 << 20), b"WARC/1.1\r\nContent-Length: 3000000\r\n\r\n" + b"x" * 3_000_000 + A.END):
        with pytest.raises(A.WarcError):
            A.read_record(next(A.members(iter([zlib_member(raw)]))))


def test_folders_without_a_scheme_are_where_spark_finds_them(spark):
    assert C.qualified(spark, "/some/where") == "file:///some/where" == C.qualified(spark, "file:/some/where")


def zlib_member(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u1", big, "x"), (2, "u2", big, "x"), (9, None, big, "x"), (3, "u3", "small", "x"), (4, "u4", "small", "x"), (5, "u5", None, "x"), (None, "u6", "no id", "x"), (6, "u6", "z" * 300_000, "x"), (9, None, big, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    written = A.write_archives(pages, archive_bytes=500, folder=str(tmp_path / "out"))
    assert sum(r["records"] for r in written.collect()) == len(rows) and len(list((tmp_path / "out").iterdir())) == written.count()
    got = sorted(((r["page_id"] or 0, r["uri"] or "", r["record_type"], r["refers_to"] or 0, r["payload_bytes"], bytes(r["payload"] or b"")) for r in A.read_archives(written).collect()))
    raw = big.encode()
    want = [(1, "u1", "revisit", 9, 1200, b""), (2, "u2", "revisit", 9, 1200, b""), (9, "", "response", 0, 1200, raw), (9, "", "response", 0, 1200, raw), (3, "u3", "response", 0, 5, b"small"), (4, "u4", "response", 0, 5, b"small"), (5, "u5", "response", 0, 0, b""), (0, "u6", "response", 0, 5, b"no id"), (6, "u6", "response", 0, 300_000, b"z" * 300_000)]
    assert got == sorted(want)
    assert A.read_archives(A.write_archives(pages.limit(0))).count() == 0
    assert A.read_archives(written, with_payload=False).where(F.col("payload").isNotNull()).count() == 0
