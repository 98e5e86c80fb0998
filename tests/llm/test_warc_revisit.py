import base64
import hashlib

import pytest
from vecloom.llm import warc_revisit as R
from vecloom.llm.common import scratch
from vecloom.llm.queries import op7_warc_revisit

SCHEMA = "page_id long, url string, html string, type string, digest string, payload string"


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_query(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    last = {}
    for i, h in pages.items():
        last[sha(h)] = max(last.get(sha(h), -1), i)
    rows = op7_warc_revisit(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        h = pages[r["page_id"]]
        first = last[sha(h)]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), sha(h))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))


def edge_pages(spark):
    rows = [(1, "http://a/1", "same"), (2, None, "same"), (3, "http://a/\r\nX: y z", "same"), (4, "", None), (5, "u", ""), (6, "é", "a\r\n\r\nWARC/1.1\r\n\r\n b\n"), (6, "é", "a\r\n\r\nWARC/1.1\r\n\r\n b\n"), (None, "n", "same"), (None, "m", "alone"), (7, "l", "日本" * 50_000)]
    return spark.createDataFrame([(*r, "t", "d", "p") for r in rows], SCHEMA)


def test_edges(spark):
    rows = R.archive(edge_pages(spark)).collect()
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in rows)
    assert got == sorted([(1, "revisit", 3, 4), (2, "revisit", 3, 4), (3, "response", 0, 4), (4, "revisit", 5, 0), (5, "response", 0, 0), (6, "response", 0, 20), (6, "revisit", 6, 20), (-1, "revisit", 3, 4), (-1, "response", 0, 5), (7, "response", 0, 300_000)])
    ids = {r["record_id"]: r for r in rows}
    assert len(ids) == len(rows)
    for r in rows:
        if r["record_type"] == "revisit":
            assert ids[r["refers_to_record"]]["record_type"] == "response" and ids[r["refers_to_record"]]["payload_digest"] == r["payload_digest"]
    assert R.archive(edge_pages(spark).limit(0)).count() == 0


def test_payloads_come_back(spark):
    pages = edge_pages(spark)
    plain, final = scratch(spark, "test"), scratch(spark, "test")
    R.write_responses(pages, plain)
    assert sorted((r["payload"] for r in R.read(spark, plain, True).collect())) == sorted(r["html"] or "" for r in pages.collect())
    R.resolve(spark, plain, final)
    kept = [r["payload"] for r in R.read(spark, final, True).where("type = 'response'").collect()]
    assert sorted(kept) == sorted({r["html"] or "" for r in pages.collect()})


@pytest.mark.parametrize("bits_bytes", [1 << 20, 300])
def test_two_writes_into_one_folder(spark, bits_bytes):
    """Archives of several writes, one of them there twice: each payload stays once."""
    plain, final = scratch(spark, "test"), scratch(spark, "test")
    page = "page_id long, url string, html string"
    for rows in ([(1, "a", "A"), (2, "b", "A")], [(11, "c", "B"), (12, "d", "C")], [(11, "c", "B"), (13, "e", "C"), (14, "f", "A")]):
        R.write_responses(spark.createDataFrame(rows, page).coalesce(1), plain)
    assert R.read(spark, plain).count() == R.read(spark, plain).select("rid").distinct().count() == 7
    R.resolve(spark, plain, final, bits_bytes)
    rows = R.read(spark, final, True).collect()
    assert sorted((r["page"], r["payload"]) for r in rows if r["type"] == "response") == [(11, "B"), (13, "C"), (14, "A")]
    assert sorted((r["page"], r["original_page"]) for r in rows if r["type"] == "revisit") == [(1, 14), (2, 14), (11, 11), (12, 13)]


def test_files_are_bounded(spark):
    plain = scratch(spark, "test")
    R.write_responses(spark.createDataFrame([(i, "u", f"{i} " * 200) for i in range(40)], "page_id long, url string, html string").coalesce(1), plain, bundle_bytes=1000, bundles=2)
    found = R.read(spark, plain, True)
    assert found.count() == 40 and found.select("file").distinct().count() > 5
    assert {r["page"] for r in found.collect()} == set(range(40))


def test_broken_archives():
    good = (R.record("response", {"WARC-Record-ID": "x"}, "abc") + R.BETWEEN).encode()
    assert [bytes(b) for _, b in R.parse(good * 2)] == [b"abc"] * 2
    for bad in (good[:-1], good + b"x", b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(R.parse(bad))
