"""Legacy ARC archives, their conversion to WARC, and WARC reading.

ARC is a version block, then per record a header line and as many bytes as it declares.
Version 1 lines have five fields, version 2 lines ten; the last is always the length. The
converter reads the line by the file's own version and makes up what WARC wants and ARC lacks:
identifiers, ISO timestamps, record types and digests. Records that repeat a payload become
revisits. Every record is a gzip member of its own.

Files are written by tasks into the shared folder, a few tens of MB each; a task streams and
holds one record at a time.
"""

import gzip
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.llm.common import Scratch, attempt_file, batch_of, filesystem, table
from hustings.llm.registry import query

# Field names of the two versions and the profile of a revisit.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SHARD_BYTES = 32 << 20  # of records, before compression
REVISIT_FROM = 100  # bytes of the smallest payload that is worth a revisit
LEVEL = 4


# --- ARC -------------------------------------------------------------------------------


def member(data: bytes) -> bytes:
    return gzip.compress(data, LEVEL, mtime=0)


def arc_head(version: int, name: str) -> bytes:
    body = f"{version} 0 Archive\n{FIELDS[version]}\n\n".encode()
    rest = ["text/plain"] if version == 1 else ["text/plain", "200", "-", "-", "0", name]
    line = " ".join([f"filedesc://{name}", "0.0.0.0", "20000101000000", *rest, str(len(body))])
    return member(line.encode() + b"\n" + body)


def arc_record(version: int, url: str, date: str, mime: str, content: bytes, offset: int, name: str) -> bytes:
    middle = [] if version == 1 else ["200", hashlib.md5(content).hexdigest(), "-", str(offset), name]
    line = " ".join([url, "0.0.0.0", date, mime, *middle, str(len(content))])
    return member(line.encode() + b"\n" + content + b"\n")


def arc_url(url: str | None) -> str:
    """The URL as a field of a line: white space and control characters are escaped; null is `-`."""
    return quote(url, safe="/:?#[]@!$&'()*+,;=%~") if url else "-"


def arc_records(source) -> Iterator[dict]:
    """Records of an ARC stream (its gzip members read through), without the version block."""
    line = source.readline()
    fields = line.decode("utf-8", "replace").split()
    body = source.read(int(fields[-1]))
    if not fields[0].startswith("filedesc:") or not body[:1].isdigit():
        raise ValueError("not an ARC file")
    version = int(body.split(None, 1)[0])
    names = body.split(b"\n")[1].decode().split()
    if version not in FIELDS or len(names) != len(FIELDS[version].split()):
        raise ValueError(f"ARC version {version} with {len(names)} fields")
    while True:
        line = source.readline()
        if not line:
            return
        if line == b"\n":  # what ends a record, and empty lines between records
            continue
        # A URL of a careless writer may hold blanks: the fields behind it are counted from the end.
        parts = line.decode("utf-8", "replace").rstrip("\n").split(" ")
        extra = len(parts) - len(names)
        if extra < 0:
            raise ValueError(f"an ARC line with {len(parts)} of {len(names)} fields")
        found = dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]))
        size = int(found["Archive-length"])
        content = source.read(size)
        if len(content) < size:
            raise ValueError("an ARC record ends early")
        yield found | {"content": content}


# --- WARC ------------------------------------------------------------------------------


def record_id(key: int, known: bool, salt: bytes) -> uuid.UUID:
    """A version 8 UUID that carries a 64-bit key and whether it is a page's id."""
    key &= (1 << 64) - 1
    low = int.from_bytes(hashlib.sha256(salt).digest()[:8]) & ((1 << 58) - 1)
    return uuid.UUID(
        int=(key >> 16) << 80 | 8 << 76 | int(known) << 75 | ((key >> 5) & 0x7FF) << 64 | 2 << 62 | (key & 0x1F) << 57 | low >> 1
    )


def key_of(identifier: str) -> int | None:
    """The page id inside a record identifier, if it is one."""
    value = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    if not value >> 75 & 1:
        return None
    key = (value >> 80) << 16 | (value >> 64 & 0x7FF) << 5 | (value >> 57 & 0x1F)
    return struct.unpack("<q", struct.pack("<Q", key))[0]


def warc_date(date: str) -> str:
    """14 digits as ISO time; shorter or odd dates count from their leading digits."""
    digits = re.match(r"\d*", date)[0][:14]
    pattern = "20000101000000"
    whole = digits + pattern[len(digits) :]
    try:
        return datetime.strptime(whole, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "2000-01-01T00:00:00Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return member(b"WARC/1.1\r\n" + "".join(lines).encode() + b"\r\n" + block + b"\r\n\r\n")


def warc_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    while True:
        line = source.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = source.read(size)
        if len(block) < size:
            raise ValueError("a WARC record ends early")
        yield headers, block


def http_parts(content: bytes) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    """Head (with its empty line), payload and header fields; no head if it isn't HTTP."""
    if not content.startswith(b"HTTP/"):
        return b"", content, {}
    head, gap, payload = content.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    return head + gap, payload, {k.lower(): v for k, v in fields.items()}


# --- jobs ------------------------------------------------------------------------------

FILES = "path string, records long"
FILES_ARROW = pa.schema([("path", pa.string()), ("records", pa.int64())])


def write_arc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) as ARC files: (path, records).

    A record is an HTTP response whose payload is the html in UTF-8 (null: empty); its head
    carries the page_id. Files are of either version, by their first page.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = uri = None
        count = size = offset = 0
        for batch in batches:
            for page_id, url, html in zip(
                batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html")
            ):
                if sink is None:
                    version = 1 + zlib.crc32(str(page_id).encode()) % 2
                    fs, path, uri = attempt_file(folder, "pages", ".arc.gz")
                    name = path.rsplit("/", 1)[-1]
                    sink, count, size = fs.open_output_stream(path, compression=None), 0, 0
                    sink.write(head := arc_head(version, name))
                    offset = len(head)
                payload = (html.as_py() or "").encode("utf-8", "replace")
                own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
                content = (
                    f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n"
                ).encode() + payload
                when = datetime(2000, 1, 1) + timedelta(seconds=(page_id or 0) % 10**9)
                data = arc_record(version, arc_url(url), when.strftime("%Y%m%d%H%M%S"), "text/html", content, offset, name)
                sink.write(data)
                offset += len(data)
                count += 1
                size += len(content)
                if size >= shard_bytes:
                    sink.close()
                    yield batch_of(FILES_ARROW, [uri], [count])
                    sink = None
        if sink is not None:
            sink.close()
            yield batch_of(FILES_ARROW, [uri], [count])

    return pages.select("page_id", "url", "html").mapInArrow(write, FILES)


INDEX = "path string, n long, page_id long, payload_bytes long, digest string, url string, date string"
INDEX_ARROW = pa.schema(
    [
        ("path", pa.string()), ("n", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
        ("digest", pa.string()), ("url", pa.string()), ("date", pa.string()),
    ]
)


def opened(uri: str):
    fs, path = filesystem(uri)
    return gzip.GzipFile(fileobj=fs.open_input_file(path), mode="rb")


def by_file(files: DataFrame) -> DataFrame:
    """The rows of a table of files, about a file a task."""
    return files.select("path").repartition(max(1, files.count()), "path")


def index_arc(files: DataFrame) -> DataFrame:
    """A row per ARC record with its payload's size and digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                rows = []
                with opened(uri) as source:
                    for n, found in enumerate(arc_records(source)):
                        _, payload, fields = http_parts(found["content"])
                        own = fields.get(b"x-page-id")
                        digest = hashlib.sha256(payload).hexdigest()
                        rows.append((uri, n, int(own) if own else None, len(payload), digest, found["URL"], found["Archive-date"]))
                        if len(rows) == 4096:
                            yield batch_of(INDEX_ARROW, *zip(*rows))
                            rows = []
                if rows:
                    yield batch_of(INDEX_ARROW, *zip(*rows))

    return by_file(files).mapInArrow(read, INDEX)


def first_of_each(index: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """`index` with `first`: the record that has the payload, null if it is this one.

    Of records with equal payloads of at least `least` bytes that with the smallest page_id
    stays (records without one come last, equal ones by file and place).
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "n", "url", "date")
    large = index.where(F.col("payload_bytes") >= least)
    first = large.groupBy("digest", "payload_bytes").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    joined = index.join(first.where("copies > 1").drop("copies"), ["digest", "payload_bytes"], "left")
    own = (F.col("first.path") == F.col("path")) & (F.col("first.n") == F.col("n"))
    return joined.withColumn("first", F.when(~own, F.col("first")))


def convert(files: DataFrame, folder: str, scratch: Scratch, least: int = REVISIT_FROM) -> DataFrame:
    """Convert ARC files to WARC files of `folder`, file by file: (path, records).

    The ARC files are read twice, once for the digests and once to copy; between the passes
    only narrow rows are shuffled, and the repeats of a frequent payload are found with a
    partial aggregate and a join of one row per payload.
    """
    index = scratch.save(index_arc(files), "arc-index")
    plan = first_of_each(index, least).select(
        "path", "n", "digest", "payload_bytes", F.col("first.page_id").alias("to_page"), F.col("first.path").alias("to_path"),
        F.col("first.n").alias("to_n"), F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"),
    )
    placed = plan.repartition(max(1, files.count()), "path").sortWithinPartitions("path", "n")

    def identify(page_id, path: str, n: int, date: str) -> str:
        salt = f"{path.rsplit('/', 1)[-1]}#{n}#{date}".encode()
        key = page_id if page_id is not None else int.from_bytes(hashlib.sha256(salt).digest()[8:16])
        return f"<urn:uuid:{record_id(key, page_id is not None, salt)}>"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sink = uri = records = source = None
        count = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != at:
                    if sink is not None:
                        sink.close()
                        source.close()
                        yield batch_of(FILES_ARROW, [uri], [count])
                    at, count = row["path"], 0
                    source = opened(at)
                    records = arc_records(source)
                    fs, path, uri = attempt_file(folder, "pages", ".warc.gz")
                    sink = fs.open_output_stream(path, compression=None)
                    info = f"software: converter\r\nformat: WARC/1.1\r\nconverted-from: {at.rsplit('/', 1)[-1]}\r\n"
                    sink.write(
                        warc_record(
                            [
                                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", identify(None, at, -1, "")),
                                ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields"),
                            ],
                            info.encode(),
                        )
                    )
                found = next(records)
                sink.write(converted(row, found))
                count += 1
        if sink is not None:
            sink.close()
            source.close()
            yield batch_of(FILES_ARROW, [uri], [count])

    def converted(row: dict, found: dict) -> bytes:
        head, payload, fields = http_parts(found["content"])
        own = fields.get(b"x-page-id")
        page_id = int(own) if own else None
        headers = [
            ("WARC-Record-ID", identify(page_id, row["path"], row["n"], found["Archive-date"])),
            ("WARC-Target-URI", found["URL"]),
            ("WARC-Date", warc_date(found["Archive-date"])),
            ("WARC-IP-Address", found["IP-address"]),
            ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ]
        kind = "application/http;msgtype=response" if head else found["Content-type"]
        if row["to_path"] is not None:
            block = head
            headers = [
                ("WARC-Type", "revisit"), *headers, ("WARC-Profile", PROFILE), ("X-Payload-Length", str(row["payload_bytes"])),
                ("WARC-Refers-To", identify(row["to_page"], row["to_path"], row["to_n"], row["to_date"])),
                ("WARC-Refers-To-Target-URI", row["to_url"]), ("WARC-Refers-To-Date", warc_date(row["to_date"])),
            ]
        else:
            block = found["content"]
            headers = [("WARC-Type", "response" if head or found["URL"].startswith("dns:") else "resource"), *headers]
        digest = hashlib.sha256(block).hexdigest()
        return warc_record([*headers, ("WARC-Block-Digest", f"sha256:{digest}"), ("Content-Type", kind)], block)

    return placed.mapInArrow(write, FILES)


ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string"
ROWS_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("warc_date", pa.string()),
    ]
)


def read_warc(files: DataFrame) -> DataFrame:
    """A row per response, resource or revisit of WARC files.

    Size and digest are of the full payload: of what is stored, whose digest must be the
    declared one, and of what a revisit declares.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                rows = []
                with opened(uri) as source:
                    for headers, block in warc_records(source):
                        kind = headers["warc-type"]
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        declared = headers["warc-payload-digest"].removeprefix("sha256:")
                        _, payload, _ = http_parts(block)
                        if kind == "revisit":
                            size, target = int(headers["x-payload-length"]), key_of(headers["warc-refers-to"])
                        else:
                            size, target = len(payload), None
                            if hashlib.sha256(payload).hexdigest() != declared:
                                raise ValueError(f"{headers['warc-record-id']}: the payload is not the declared one")
                        rows.append(
                            (key_of(headers["warc-record-id"]), size, declared, kind, target, headers["warc-target-uri"], headers["warc-date"])
                        )
                        if len(rows) == 4096:
                            yield batch_of(ROWS_ARROW, *zip(*rows))
                            rows = []
                if rows:
                    yield batch_of(ROWS_ARROW, *zip(*rows))

    return by_file(files).mapInArrow(read, ROWS)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` as ARC, convert to WARC and read that: one row per page.

    An empty table writes no file. A null url is `-`; a null html has an empty payload; a null
    page_id is null again, and a revisit of such a page has no `refers_to`. Rows of
    one page_id are records of their own, and the later ones of one payload revisit the
    first. The ARC files are removed once they are converted.
    """
    scratch = Scratch(pages.sparkSession, "archives")
    legacy = scratch.save(write_arc(pages, scratch.path("arc")), "arc-files")
    warc = scratch.save(convert(legacy, folder or scratch.path("warc"), scratch), "warc-files")
    scratch.drop("arc", "arc-index")
    return read_warc(warc)


ORACLE = """
WITH pages_ AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM pages_
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to FROM firsts
"""


@query("op6_archives", ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
