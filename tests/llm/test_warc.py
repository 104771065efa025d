from __future__ import annotations

import base64
import hashlib

import pytest

from feedspark.llm import warc as W

PAGES = "page_id bigint, url string, html string, record_type string"


def test_roundtrip(spark, tmp_path):
    rows = [(5, "http://a", "<p>same</p>", "x"), (2, "http://b\r\nX: y", "<p>same</p>", "x"), (7, None, None, "x"), (3, "http://c", "", "x"), (9, "u", "é" * 60_000, "x"), (11, "u", "<p>same</p>", "x"), (12, "u", "a\r\n\r\nb", None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = {r.page_id: r for r in W.roundtrip(pages).collect()}
    assert set(got) == {r[0] for r in rows}
    for pid, _, html, _ in rows:
        data = (html or "").encode()
        first = min(p for p, _, h, _ in rows if (h or "") == (html or ""))
        r = got[pid]
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if pid == first else ("revisit", first))
    for a in W.write_archives(pages).collect():
        (tmp_path / a.archive).write_bytes(a.content)
    back = W.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).where("record_type = 'response'").collect()
    assert {(int(r.page_id), bytes(r.payload).decode()) for r in back} == {(p, h or "") for p, _, h, _ in rows if p in (2, 3, 9, 12)}


def test_small_payloads_and_odd_ids(spark):
    pages = spark.createDataFrame([(1, "u", "aa", ""), (2, "u", "aa", ""), (3, "u", "bbbb", ""), (4, "u", "bbbb", ""), (None, "u", "bbbb", ""), (3, "u", "bbbb", "")], PAGES)
    got = W.read_archives(W.write_archives(pages, dedup_from=3)).collect()
    assert sorted((r.page_id or "", r.record_type, r.refers_to or "") for r in got) == [("", "response", ""), ("1", "response", ""), ("2", "response", ""), ("3", "response", ""), ("3", "response", ""), ("4", "revisit", "3")]


def test_ids_come_back_as_they_were(spark):
    ids = ["None", " a", "b\r\nX: y", "100%", "ключ", "", None, "c"]
    pages = spark.createDataFrame([(i, "u", f"{i}", "") for i in ids] + [("d", "u", "c", "")], "page_id string, url string, html string, record_type string")
    got = W.roundtrip(pages).collect()
    assert sorted((r.page_id, r.refers_to) for r in got if r.page_id is not None) == sorted([*((i, None) for i in ids if i is not None and i != "None"), ("d", "c"), ("None", None)])
    assert [r.record_type for r in got if r.page_id is None] == ["response"]


def test_empty(spark):
    assert W.roundtrip(spark.createDataFrame([], PAGES)).count() == 0


def test_faults():
    record = W.build_record("response", 1, "http://a", b"body", W.digest(b"body"))
    dictionary = W.train_dictionary([b"tiny"])
    w = W.Writer(dictionary)
    w.add(record)
    data = w.content()
    assert [r["payload"] for r in W.read_archive(data)] == [b"body"]
    for bad in (data[:-3], data + b"junk", data[:4] + b"\xff\xff\xff\xff", data + data[-4:]):
        with pytest.raises(W.WarcError):
            list(W.read_archive(bad))
    for wrong in (record.replace(b"Content-Length: 4\r\n", b"Content-Length: 5\r\n"), record.replace(b"WARC-Date", b"X-Date"), record[:-2], record.replace(b"body", b"bodx"), record.replace(b"WARC-Type: response", b"WARC-Type: odd")):
        with pytest.raises(W.WarcError):
            W.parse_record(wrong)
    two = W.Writer(dictionary)
    two.add(record + record)
    with pytest.raises(W.WarcError):
        list(W.read_archive(two.content()))


def test_compressed_dictionary():
    import zstandard

    samples = [f"<html><body>page {i} of words and words {i * i}</body></html>".encode() * 4 for i in range(300)]
    dictionary = W.train_dictionary(samples, 2048)
    w = W.Writer(dictionary)
    w.add(W.build_record("response", 1, "u", samples[0], W.digest(samples[0])))
    packed = W.dictionary_frame(zstandard.ZstdCompressor().compress(dictionary)) + b"".join(w.parts[1:])
    assert next(W.read_archive(packed))["payload"] == samples[0]
