import hashlib
import uuid

import pytest

from plumbline.durable import shared_dir
from plumbline.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def archive(spark, rows):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), path)
    return path


LONG = "ä" * 600
ROWS = [
    (1, "http://a/", LONG, "x"),
    (2, "http://b/\r\nX: y", LONG, "x"),
    (3, None, LONG, None),
    (4, "http://c/", "short", "x"),
    (5, "http://d/", "short", "x"),
    (6, "http://e/", None, "x"),
    (7, "http://f/", "", "x"),
    (8, "http://g/", "b" * 1000, "x"),
    (8, "http://g/", "b" * 1000, "x"),
    (None, "http://h/", LONG, "x"),
]


def test_summary(spark):
    got = warc.read_summary(spark, archive(spark, ROWS)).collect()
    found = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = []
    for page, _, html, _ in ROWS:
        data = (html or "").encode()
        refers = 3 if html == LONG and page != 3 else None
        want.append((page or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
    assert found == sorted(want, key=lambda r: r[:4])


def test_records_come_back_byte_for_byte(spark):
    got = warc.read_records(spark, archive(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    html = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in got:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        lines = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        block = rest[: int(lines[b"Content-Length"])]
        assert rest == block + b"\r\n\r\n"
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200")
        assert payload == (html[r.page_id] if r.record_type == "response" else b"")
        assert lines[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(html[r.page_id]).hexdigest().encode()


def test_record_ids(spark):
    """Different records of one page have different ids, and revisits name the id of their response."""
    rows = [(1, "http://a/", LONG, "x"), (2, "http://b/", LONG, "x"), (2, "http://c/", LONG, "x"), (2, None, "x", "x"), (2, "", "x", "x"), (2, "", "y", "x")]
    records = [bytes(r.record).decode() for r in warc.read_records(spark, archive(spark, rows)).collect()]
    lines = [dict(x.split(": ", 1) for x in r.split("\r\n\r\n")[0].split("\r\n")[1:]) for r in records]
    ids = {x["WARC-Record-ID"]: x for x in lines}
    assert len(ids) == len(rows)
    (revisit,) = (x for x in lines if x["WARC-Type"] == "revisit")
    referred = ids[revisit["WARC-Refers-To"]]
    assert (referred["WARC-Type"], referred["WARC-Target-URI"]) == ("response", "http://c/")


def test_payloads_are_stored_once(spark):
    stored = spark.read.parquet(archive(spark, ROWS) + "/payloads")
    assert stored.count() == len({r[2] or "" for r in ROWS})


def test_damage_is_noticed(spark):
    path = archive(spark, ROWS[:2])
    stored = spark.read.parquet(path + "/payloads").selectExpr("digest", "binary('other') AS payload")
    with pytest.raises(Exception, match="does not match its digest"):
        warc._verified(spark, path, stored).collect()


def test_no_pages(spark):
    assert warc.read_summary(spark, archive(spark, [])).collect() == []
