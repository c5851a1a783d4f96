from __future__ import annotations

import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F
from sparkwarden.llm.warc import archived_pages, fetch_records, parse_record, read_archives, seek_table, write_archives

SCHEMA = "page_id long, url string, html string, record_type string"
BODY = "<p>" + "x" * 200 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (5, "http://a/5", BODY, "z"),
        (3, None, BODY, "z"),
        (9, "http://a/9\r\nX: y z", BODY, "z"),
        (9, "http://a/9", BODY, "z"),
        (1, "http://b/", None, "z"),
        (2, "http://b/", "", "z"),
        (4, "http://b/", "short", "z"),
        (6, "http://b/", "short", "z"),
        (7, "http://c/", "é\r\n\r\nWARC/1.1\r\n" * 60000, "z"),
        (None, "http://c/", BODY, "z"),
        (8, "http://c/", "y" * 100, "z"),
        (10, "http://c/", "y" * 100, "z"),
        (11, "http://c/", "y" * 99, "z"),
        (12, "http://c/", "y" * 99, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(row):
    return (row[0] is None, tuple(str(v) for v in row))


def test_records_and_revisits(pages):
    got = archived_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    first = {BODY: 3, "y" * 100: 8}
    want = []
    for r in pages.collect():
        html = r["html"] or ""
        revisit = html in first and r["page_id"] is not None and r["page_id"] > first[html]
        data = html.encode()
        want.append(
            (r["page_id"], len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None)
        )
    assert sorted(map(tuple, got), key=by_id) == sorted(want, key=by_id)


def test_bundles_seek_and_read_back(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/archive"
    index = write_archives(pages.coalesce(1), folder, frame_bytes=2000, bundle_bytes=300)
    rows = index.collect()
    files = sorted((tmp_path / "archive").glob("*.warc.zst"))
    assert len(files) > 1 and {r["bundle"] for r in rows} == {f.name for f in files}
    payloads = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for file in files:
        data = file.read_bytes()
        table = seek_table(data)
        plain = b"".join(zstandard.ZstdDecompressor().decompress(data[o : o + c]) for o, c, _ in table)
        assert [len(zstandard.ZstdDecompressor().decompress(data[o : o + c])) for o, c, _ in table] == [d for *_, d in table]
        # Any reader reads the frames in turn and skips the seek table.
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == plain
        for r in rows:
            if r["bundle"] == file.name:
                offset, packed, _ = table[r["frame"]]
                assert offset == r["frame_offset"]
                frame = zstandard.ZstdDecompressor().decompress(data[offset : offset + packed])
                headers, _, end = parse_record(frame, r["offset_in_frame"])
                assert headers["warc-record-id"] == f"<{r['record_id']}>" and end - r["offset_in_frame"] == r["length"]
    assert len({r["record_id"] for r in rows}) == len(rows) == pages.count()
    read = read_archives(spark, folder).collect()
    assert all(r["payload"] == payloads[r["page_id"]] for r in read if r["record_type"] == "response" and r["page_id"] is not None)
    assert next(r["url"] for r in read if r["page_id"] == 9 and "X:" in r["url"]) == "http://a/9%0D%0AX:%20y%20z"
    wanted = fetch_records(index.where("page_id in (7, 9)"), folder).collect()
    assert len(wanted) == 3 and next(r["payload"] for r in wanted if r["page_id"] == 7) == payloads[7]


def test_a_second_attempt_writes_the_same_bundles(spark, pages, tmp_path):
    """Rows come to a task in another order when it runs again: the first index still finds its records."""
    folder = f"file://{tmp_path}/archive"
    rows = pages.where("page_id is not null").collect()
    one = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    two = spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1)
    small = {"frame_bytes": 2000, "bundle_bytes": 300}
    index = write_archives(one, folder, **small)
    want = {(r["record_id"], r["page_id"], r["payload_digest"]) for r in fetch_records(index, folder).collect()}
    write_archives(two, folder, **small)
    assert {(r["record_id"], r["page_id"], r["payload_digest"]) for r in fetch_records(index, folder).collect()} == want
    assert len(want) == len(rows)


def test_another_bundle_under_the_name_is_seen(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/archive"
    index = write_archives(pages, folder)
    odd = index.withColumn("record_id", F.lit("urn:uuid:0"))
    with pytest.raises(Exception, match="the index does not belong"):
        fetch_records(odd, folder).collect()


def test_empty_table(pages):
    assert archived_pages(pages.limit(0)).count() == 0


def test_damage_is_seen():
    with pytest.raises(ValueError):
        seek_table(b"x" * 20)
    with pytest.raises(ValueError):
        parse_record(b"HTTP/1.1 200 OK\r\n\r\n")
