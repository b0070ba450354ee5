"""Operator 10: legacy ARC archives to WARC.

ARC 1 records have a header line of five fields, ARC 2 records one of ten; the file's first record (filedesc) states the
version.  The last field is the declared length of what follows.  Each record becomes an equivalent WARC record: an identifier
(UUID of the key and digest), the date in ISO form, the type (response, or revisit of an equal payload) and payload and block
digests.  Archives are kept as rows of bytes (one gzip member a record) in the shared folder, where any executor reads them.
`arc_records` reads ARC files from storage, one task a file at most.

Which record a page revisits is found from (id, digest) alone: a popular payload's ids are dealt to several tasks, and the payloads
themselves are joined by (id, digest) with the revisits.  A revisit carries its response's key in its own fields, so reading needs no join.

Defined cases: a null payload is the empty payload; a null URL is written as about:blank; white space and control bytes in URLs are
percent-encoded; blanks inside a content type are read as part of it; a date of 12 digits has no seconds, which are 00; a declared length
beyond the end, or a header line of another shape, raises ValueError; payloads of under 100 bytes are always responses; of rows with the
least id of a payload all are responses; a null id is a page of its own, the greatest; very long payloads make archives of fewer records;
an empty table gives an empty table; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import SALTS, slices, stored

#: The field lines of the two versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
LEAST_REVISIT = 100


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    content_type: str
    offset: int
    content: bytes


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def write_arc(records: list[tuple[str | None, str, bytes]], version: int = 1, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An ARC file of (url, content type, content)."""
    about = f"{version} 0 marginalia\n{ARC_FIELDS[version]}\n".encode()
    out = bytearray()

    def add(url: str, kind: str, content: bytes) -> None:
        more = [] if version == 1 else ["200", "-", "-", str(len(out)), name]
        ip = "0.0.0.0"  # noqa: S104
        out.extend(" ".join([url, ip, date, kind, *more, str(len(content))]).encode() + b"\n" + content + b"\n")

    add(f"filedesc://{name}", "text/plain", about)
    for url, kind, content in records:
        add(clean_url(url), kind, content)
    return bytes(out)


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file without its filedesc, by the header lines of its version and their declared lengths."""
    at, fields = 0, None
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":  # what separates records
            at += 1
            continue
        end = raw.find(b"\n", at)
        head = raw[at : end if end >= 0 else len(raw)].decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is None:
            if not head[0].startswith("filedesc://") or not head[-1].isdigit():
                raise ValueError("an ARC file starts with a filedesc record")
            version = raw[end + 1 : end + 2]
            fields = {b"1": 5, b"2": 10}.get(version)
            if fields is None:
                raise ValueError(f"ARC version {version!r}")
        elif len(head) < fields or not head[-1].isdigit():
            raise ValueError(f"ARC header of {len(head)} fields at {at}, not {fields}")
        length = int(head[-1])
        if end < 0 or end + 1 + length > len(raw):
            raise ValueError(f"ARC record at {at} declares {length} bytes, beyond the end")
        if not head[0].startswith("filedesc://"):
            kind = " ".join(head[3 : len(head) - fields + 4])  # the one field that may hold blanks
            yield ArcRecord(head[0], head[1], head[2], kind, at, raw[end + 1 : end + 1 + length])
        at = end + 1 + length


def record_id(key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {digest}')}>"


def to_warc(record: ArcRecord, key: str, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record.  refers_to: the key of the record with the same payload, if this one shall be a revisit."""
    head, mark, payload = record.content.partition(b"\r\n\r\n") if record.content.startswith(b"HTTP/") else (b"", b"", record.content)
    digest = hashlib.sha256(payload).hexdigest()
    block = record.content if refers_to is None else head + mark
    d = record.date.ljust(14, "0")
    fields = {
        "WARC-Type": "response" if mark else "resource",
        "WARC-Record-ID": record_id(key, digest),
        "WARC-Target-URI": record.url,
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-IP-Address": record.ip,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),  # noqa: S324
        "Content-Type": "application/http; msgtype=response" if mark else record.content_type,
    }
    if refers_to is not None:
        fields |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Key": refers_to}
    fields["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzipped(record: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive of gzip members."""
    while raw:
        unpack = zlib.decompressobj(31)
        data = unpack.decompress(raw) + unpack.flush()
        raw = unpack.unused_data
        if not data.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        if len(rest) < n + 4:
            raise ValueError("a WARC record is cut off")
        yield fields, rest[:n]


def http_response(payload: bytes, key: str) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Record-Key: {key}\r\n\r\n".encode() + payload


def revisits(pages: DataFrame) -> DataFrame:
    """(_id, digest, refers): the rows of `pages` (_id, digest, n bytes) whose payload another row with a smaller id has.

    Rows of a digest are dealt by a hash of their ids, and the least ids of these parts meet, so no task holds a popular payload's rows.
    """
    rows = pages.where(F.col("n") >= LEAST_REVISIT).select("_id", "digest").withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    parts = rows.groupBy("digest", "_s").agg(F.min("_id").alias("_least"))
    first = parts.select("digest", "_s", F.min("_least").over(Window.partitionBy("digest")).alias("refers"))
    return rows.join(first, ["digest", "_s"]).where("refers is not null and not _id <=> refers").select("_id", "digest", "refers").distinct()


def archive(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", batch: int = 64) -> DataFrame:
    """Writes every page as an ARC record, converts the ARC files to WARC and stores them: (archive binary), each of at most
    `batch` records and about 32 MB of payload."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id).alias("_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    again = revisits(rows.select("_id", "digest", F.octet_length("payload").alias("n"))).select(F.col("_id").alias("_again"), F.col("digest").alias("_digest"), "refers")
    rows = rows.join(again, F.col("_id").eqNullSafe(F.col("_again")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select(F.col("_id").cast("string").alias("key"), "url", "payload", F.col("refers").cast("string").alias("refers"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(slices(batches, batch, 2, 32 << 20)):
            keys, urls, payloads, refers = (part.column(c).to_pylist() for c in range(4))
            keys = ["" if x is None else x for x in keys]
            arc = write_arc([(u, "text/html", http_response(p, x)) for u, p, x in zip(urls, payloads, keys, strict=True)], 1 + k % 2)
            records = [gzipped(to_warc(r, x, to)) for r, x, to in zip(read_arc(arc), keys, refers, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(records)], pa.binary())], names=["archive"])

    return stored(rows.mapInArrow(work, "archive binary"), "archives")


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, url, date, content_type, warc): every record of the ARC files at `path`, as a gzipped WARC record.

    Files come from any store that Spark reads; a file is one row, so it has to fit into one task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "url", "date", "content_type", "warc"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for part in slices(batches, 1):
            file, raw = part.column(0)[0].as_py(), part.column(1)[0].as_py()
            raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw  # of one member or many
            rows = []
            for r in read_arc(raw):
                rows.append((file, r.offset, r.url, r.date, r.content_type, gzipped(to_warc(r, f"{file}#{r.offset}"))))
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "file string, offset long, url string, date string, content_type string, warc binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """(record_key, record_id, record_type, payload_bytes, payload_digest, refers_to_id, refers_to_key, target) of every record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = []
            for raw in part.column(0).to_pylist():
                for f, block in read_warc(raw):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if f["WARC-Type"] != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{f['WARC-Record-ID']}: the payload is not what its digest says")
                    rows.append((http["X-Record-Key"] or None, f["WARC-Record-ID"], f["WARC-Type"], int(http["Content-Length"]), digest, f.get("WARC-Refers-To"), f.get("X-Refers-To-Key"), f["WARC-Target-URI"]))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            names = ["record_key", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id", "refers_to_key", "target"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return archives.mapInArrow(work, "record_key string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string, refers_to_key string, target string")


def round_trip(pages: DataFrame, id: str = "page_id", **options) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from its WARC record."""
    kind = dict(pages.dtypes)[id]
    records = read_archives(archive(pages, id, **options))
    return records.select(F.col("record_key").cast(kind).alias(id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast(kind).alias("refers_to"))


ORACLE = """
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from p left join f using (d)"""
