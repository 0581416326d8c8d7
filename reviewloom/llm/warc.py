"""Web records in ZIP-packaged WARC archives, written and read by ranges.

A package is a ZIP file whose members are stored, not compressed: one archive
``archive/data.warc.gz`` with every record as a gzip member of its own, and one
index ``indexes/index.jsonl.gz`` with the place of each record. A reader needs
the last bytes of the file for the directories (ZIP64 where sizes ask for it),
the index, and then one range of bytes for each record; nothing is extracted.
Files are opened through ``pyarrow.fs``, so that a package may lie wherever all
executors reach it.
"""

import base64
import gzip
import hashlib
import json
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import filesystem, record_batch, slices, utf8
from reviewloom.session import stage, stage_path

#: Payloads from this size on may be left out where another record has the same.
LEAST_REVISIT = 1000
#: Compressed bytes after which a task starts the next package, and bytes of records that one row of the index names.
PACKAGE_BYTES, RANGE_BYTES = 64_000_000, 2_000_000
#: Parts that the rows of one payload are dealt to.
SALT = 8

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl.gz"

_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RANGES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("sizes", pa.list_(pa.int64()))])
_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)
_RECORDS_DDL = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


# Records


def record_id(page_id):
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id, url, payload: bytes, digest: str, size: int, refers_to=None) -> bytes:
    """One record, gzipped. A revisit has the HTTP header of its page and no payload."""
    shown = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",  # the table has no date; equal input gives equal bytes
        f"WARC-Payload-Digest: sha1:{shown}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + json.dumps(url)[1:-1])
    if refers_to is not None:
        head.insert(3, f"WARC-Refers-To: {record_id(refers_to)}")
        head.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _fields(head: bytes):
    lines = head.decode().split("\r\n")
    return lines[0], dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def _id_of(name):
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def parse_record(raw: bytes):
    """page_id, url, type, refers_to, payload bytes, payload digest and payload (None in a revisit)."""
    record = gzip.decompress(raw)
    head, _, rest = record.partition(b"\r\n\r\n")
    version, fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/1.") or len(block) != int(fields["Content-Length"]):
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_fields(http)[1]["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    refers_to = None
    if fields["WARC-Type"] == "revisit":
        payload, refers_to = None, _id_of(fields["WARC-Refers-To"])
    elif len(payload) != size or hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
    uri = fields.get("WARC-Target-URI")
    url = None if uri is None else json.loads(f'"{uri}"')
    return _id_of(fields["WARC-Record-ID"]), url, fields["WARC-Type"], refers_to, size, digest, payload


# Packages


class _Package:
    """Writes one package as a stream, without a local copy."""

    def __init__(self, path):
        self.path, self.sizes, self.bytes = path, [], 0
        files, place = filesystem(path)
        files.create_dir(place.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, record: bytes):
        self.archive.write(record)
        self.sizes.append(len(record))
        self.bytes += len(record)

    def close(self):
        self.archive.close()
        lines, start, held = [], 0, []
        for size in [*self.sizes, None]:
            if held and (size is None or sum(held) + size > RANGE_BYTES):
                lines.append(json.dumps({"start": start, "sizes": held}))
                start, held = start + sum(held), []
            held.append(size)
        self.zip.writestr(zipfile.ZipInfo(INDEX), gzip.compress("\n".join(lines).encode(), mtime=0))
        self.zip.close()
        self.out.close()
        return self.path, len(self.sizes), self.bytes


def read_directory(read, size) -> dict[str, tuple[int, int, int, int]]:
    """Members by name: method, place of the local header, stored size, real size.

    ``read(start, length)`` reads a range of the package of ``size`` bytes. The
    end record is searched in the last 64 KB; where it or an entry holds the
    largest number, the ZIP64 records have the real ones.
    """
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = read(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
    if locator[:4] == b"PK\x06\x07" and (count == 0xFFFF or 0xFFFFFFFF in (length, start)):
        record = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, members, at = read(start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[at + 10 : at + 12])
        stored, real, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        header, = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the 64-bit numbers of the fields that are full, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                real = wide.pop(0) if real == 0xFFFFFFFF else real
                stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        members[name] = (method, header, stored, real)
        at += 46 + n_name + n_extra + n_comment
    return members


def member_range(read, members, name):
    """First byte and size of a stored member."""
    method, header, stored, _ = members[name]
    if method != 0:
        raise ValueError(f"{name} is not stored")
    local = read(header, 30)
    n_name, n_extra = struct.unpack("<HH", local[26:30])
    return header + 30 + n_name + n_extra, stored


class _Ranges:
    """Reads ranges of a package."""

    def __init__(self, path):
        files, place = filesystem(path)
        self.file = files.open_input_file(place)
        self.size = self.file.size()

    def __call__(self, start, length):
        return self.file.read_at(length, start)


# Spark


def _write(root):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, package, done, number = TaskContext.get(), None, [], 0
        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                if package is None:  # an attempt's own name: what a lost task has written is never read
                    name = f"part-{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}"
                    package, number = _Package(f"{root}/{name}.wacz"), number + 1
                refers = row["refers_to"]
                payload = b"" if row["payload"] is None else row["payload"]
                package.add(warc_record(row["page_id"], row["url"], payload, row["digest"], row["size"], refers))
                if package.bytes >= PACKAGE_BYTES:
                    done, package = [*done, package.close()], None
        done = done if package is None else [*done, package.close()]
        if done:
            yield record_batch(done, _MANIFEST)

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            read = _Ranges(path)
            members = read_directory(read, read.size)
            first, _ = member_range(read, members, ARCHIVE)
            start, size = member_range(read, members, INDEX)
            lines = map(json.loads, gzip.decompress(read(start, size)).decode().splitlines())
            rows = [(path, first + line["start"], line["sizes"]) for line in lines]
            if rows:
                yield record_batch(rows, _RANGES)


def _records(with_payload):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, read = row["path"], _Ranges(row["path"])
                at, out = 0, []
                held = read(row["start"], sum(row["sizes"]))  # the range at once: about RANGE_BYTES, or one larger record
                for size in row["sizes"]:
                    record = parse_record(held[at : at + size])
                    out.append(record if with_payload else (*record[:-1], None))
                    at += size
                yield record_batch(out, _RECORDS)

    return run


def plan_records(pages: DataFrame, least=LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, its digest and size, and the page that a revisit refers to.

    Of equal payloads of at least ``least`` bytes the record with the largest
    page_id has the payload. Digests are reduced to that page in each task
    before they are shuffled, and the rows of one payload are dealt to ``SALT``
    parts, so that a payload of a third of the rows burdens no single task.
    Revisits give up their payload before anything is shuffled by key again.
    """
    payload = utf8("html")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    large = rows.filter(F.col("size") >= least).groupBy("digest")
    winners = large.agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    winners = stage(winners.select("digest", "winner"), "payloads").withColumn("salt", salts)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    joined = salted.join(winners, ["digest", "salt"], "left")
    refers = F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    return joined.select(
        "page_id",
        "url",
        F.when(refers.isNull(), F.col("payload")).alias("payload"),
        "digest",
        "size",
        refers.alias("refers_to"),
    )


def write_packages(pages: DataFrame, folder: str | None = None, least=LEAST_REVISIT) -> DataFrame:
    """Writes a record for every row of ``pages``; path, records and bytes of the packages.

    ``folder`` is one that all executors reach; without it, a fresh one in the
    shared folder of the session. Only packages in the returned list count: a
    task that is tried again writes under another name.
    """
    folder = folder or stage_path(pages.sparkSession, "packages")
    root = folder if "://" in folder or not folder.startswith("file:/") else "file://" + folder.removeprefix("file:")
    rows = plan_records(pages, least)
    return stage(rows.mapInArrow(_write(root), "path string, records long, bytes long"), "manifest")


def read_packages(packages: DataFrame, payloads=True) -> DataFrame:
    """The records of the packages named in ``path``; ``payload`` is NULL in revisits, or without ``payloads``.

    First the directories and indexes are read, then ranges of about 2 MB of
    records, dealt evenly. A record whose payload does not have its digest is
    an error.
    """
    paths = packages.select("path").repartition(F.col("path"))
    ranges = paths.mapInArrow(_index, "path string, start long, sizes array<long>")
    return ranges.repartition("path", "start").mapInArrow(_records(payloads), _RECORDS_DDL)


def archived_pages(pages: DataFrame, folder: str | None = None, least=LEAST_REVISIT) -> DataFrame:
    """Writes ``pages`` and reads them back: page_id, payload_bytes, payload_digest, record_type and refers_to.

    NULL html is an empty payload, NULL urls have no target field, and a row
    without page_id never is the one that others refer to; without any other
    page of the same payload it is a response. Rows repeated under the page_id
    that has the payload are all responses. An empty table writes nothing and
    gives no row; other columns are not read.
    """
    records = read_packages(write_packages(pages, folder, least), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
