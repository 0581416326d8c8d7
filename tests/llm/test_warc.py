import hashlib
import io
import zipfile
from collections import Counter

import pytest

from reviewloom.llm import warc
from reviewloom.llm.common import filesystem, pyarrow_uri

LONG = "<p>é</p>" * 200


def expected_records(rows):
    winners = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            winners[html] = max(i, winners.get(html, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = winners[html] if html in winners and i != winners[html] else None
        kind = "response" if refers is None else "revisit"
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), kind, refers))
    return Counter(out)


ROWS = [
    (1, "http://a/", LONG),
    (2, "http://b/", LONG),
    (5, None, LONG),
    (5, "http://b/", LONG),
    (3, "http://c/\r\nX: y", "short"),
    (4, "http://d/", "short"),
    (6, "", None),
    (7, "http://ü/", ""),
    (None, "http://e/", LONG),
    (None, "http://e/", LONG + "only here"),
    (8, "http://f/", "x\r\n\r\ny" * 300),
    (9, "http://g/", "z" * 3_000_000),
    (10, "http://g/", "z" * 3_000_000),
    (11, "http://h/", "a" * 999),
    (12, "http://h/", "a" * 999),
    (13, "http://h/", "a" * 1000),
    (14, "http://h/", "a" * 1000),
] + [(100 + i, f"http://hot/{i}", "hot" * 400) for i in range(60)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*r, "x", "y") for r in ROWS]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, salt string").repartition(4)


def test_round_trip(pages, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 3000)
    got = warc.archived_pages(pages)
    assert Counter(tuple(r) for r in got.collect()) == expected_records(ROWS)


def test_payloads_and_urls_come_back(pages):
    got = warc.read_packages(warc.write_packages(pages)).collect()
    expected = Counter((i, url) for i, url, _ in ROWS)
    assert Counter((r.page_id, r.url) for r in got) == expected
    htmls = {(i, len((h or "").encode())): (h or "").encode() for i, _, h in ROWS}
    for r in got:
        if r.record_type == "response":
            assert bytes(r.payload) == htmls[r.page_id, r.payload_bytes]
        else:
            assert r.payload is None


def test_no_rows(pages):
    assert warc.archived_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_directories_of_plain_and_zip64_files(zip64, monkeypatch):
    if zip64:  # the writer then takes every size for too large
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("one"), b"first member of some length")
        z.writestr(zipfile.ZipInfo("två"), b"second")
        z.comment = b"a comment PK"
    raw = out.getvalue()
    assert (b"PK\x06\x06" in raw) == zip64
    read = lambda start, length: raw[start : start + length]
    members = warc.read_directory(read, len(raw))
    assert {n: m[3] for n, m in members.items()} == {"one": 27, "två": 6}
    start, size = warc.member_range(read, members, "två")
    assert raw[start : start + size] == b"second"


def test_damage_is_an_error():
    raw = warc.warc_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), 7)
    assert warc.parse_record(raw)[-1] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(warc.warc_record(1, "u", b"payloaf", hashlib.sha1(b"payload").hexdigest(), 7))
    with pytest.raises(ValueError, match="central directory"):
        warc.read_directory(lambda start, length: b"no zip"[start : start + length], 6)
    with pytest.raises(ValueError, match="not stored"):
        warc.member_range(None, {"x": (8, 0, 1, 1)}, "x")


@pytest.mark.parametrize(
    ("path", "uri"),
    [
        ("s3a://bucket/a/b", "s3://bucket/a/b"),
        ("s3n://bucket/a", "s3://bucket/a"),
        ("wasbs://box@name.blob.core.windows.net/a", "abfss://box@name.dfs.core.windows.net/a"),
        ("wasb://box@name.blob.core.windows.net/a", "abfs://box@name.dfs.core.windows.net/a"),
        ("dbfs:/a/b", "/dbfs/a/b"),
        ("dbfs:///a/b", "/dbfs/a/b"),
        ("gs://bucket/a", "gs://bucket/a"),
        ("file:/a/b", "file:/a/b"),
        ("/a/s3a:b", "/a/s3a:b"),
    ],
)
def test_stores_go_by_the_names_that_pyarrow_knows(path, uri):
    assert pyarrow_uri(path) == uri


def test_places_in_stores():
    assert filesystem("wasbs://box@name.blob.core.windows.net/a/b")[1] == "box/a/b"
    assert filesystem("dbfs:/a/b")[1] == "/dbfs/a/b"
    assert filesystem("file:/a/b")[1] == filesystem("/a/b")[1] == "/a/b"
