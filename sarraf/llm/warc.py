"""Legacy ARC archives to WARC.

ARC versions 1 and 2 have a version block that declares the fields of the header lines that follow; each line
ends in the declared length of its body. The converter reads those lines by the declared version and writes
equivalent WARC records: an identifier that follows from URL, time and payload, the timestamp in ISO form, the
record type, and digests of block and payload. Payloads that repeat become revisit records without a body.

Archives are written by the tasks to the shared folder, one a task attempt, each record its own gzip member. The
tasks return the names, so a lost attempt's file is never read.

Defined cases: null html is an empty payload; null URLs become "about:blank"; rows equal in page_id and html are
each the response if theirs is the largest page_id; null page_id ranks below all others; an empty table gives no
archives; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads at least this long are stored once.
REVISIT_BYTES = 1000
#: Compressed bytes after which a task begins another archive: a reader holds one at a time.
ARCHIVE_BYTES = 16 << 20
#: Compressed bytes that a reader decompresses at once.
STEP = 4096
#: Payloads that repeat whose references may be broadcast, at most about 300 bytes each; beyond, the join shuffles.
BROADCAST_ROWS = 100_000

#: Fixed values of the two ARC versions: the fields of a header line.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    extra: dict[str, str]


def write_arc(records: list[ArcRecord], version: int = 1, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An uncompressed ARC file with its version block."""
    block = f"{version} 0 sarraf\n{' '.join(FIELDS[version])}\n\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {'200 - - 0 ' + name + ' ' if version == 2 else ''}{len(block)}\n".encode(), block]
    for r in records:
        middle = f" {r.extra.get('Result-code', '200')} {r.extra.get('Checksum', '-')} {r.extra.get('Location', '-')} {r.extra.get('Offset', '0')} {name}" if version == 2 else ""
        out += [f"\n{r.url} {r.ip} {r.date} {r.content_type}{middle} {len(r.body)}\n".encode(), r.body]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file by the fields that its version block declares; ValueError where it breaks off."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at byte {at} does not end")
        line = data[at:end].decode("utf-8", "surrogateescape").split(" ")
        if not line[-1].isdigit() or end + 1 + int(line[-1]) > len(data):
            raise ValueError(f"header line at byte {at} declares no length that fits")
        body = data[end + 1 : end + 1 + int(line[-1])]
        at = end + 1 + len(body)
        if names is None:
            if not line[0].startswith("filedesc:"):
                raise ValueError("no version block")
            head = body.decode("utf-8", "replace").split("\n")
            names = head[1].split(" ")
            if int(head[0].split(" ")[0]) not in FIELDS or names[0] != "URL" or names[-1] != "Archive-length":
                raise ValueError(f"unknown version block {head[:2]}")
            continue
        # A content type or URL of old tools may hold spaces: the last fields are counted from the right.
        spare = len(line) - len(names)
        if spare < 0:
            raise ValueError(f"header line before byte {at} has {len(line)} fields, not {len(names)}")
        line = [" ".join(line[: spare + 1]), *line[spare + 1 :]]
        x = dict(zip(names, line, strict=True))
        yield ArcRecord(x["URL"], x.get("IP-address", "0.0.0.0"), x["Archive-date"], x.get("Content-type", "no-type"), body, {k: v for k, v in x.items() if k not in ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")})


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Response header with its blank line, and payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    at, gap = body.find(b"\r\n\r\n"), 4
    if at < 0:
        at, gap = body.find(b"\n\n"), 2
    return (body, b"") if at < 0 else (body[: at + gap], body[at + gap :])


def record_id(url: str, date: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {payload_digest}')}>"


def to_warc(r: ArcRecord, more: dict[str, str], revisit: bool = False) -> bytes:
    """One WARC record. A revisit keeps the response's header and states digest and length of the payload it leaves out."""
    head, payload = split_http(r.body)
    digest = hashlib.sha1(payload).hexdigest()
    block = head if revisit else head + payload
    iso = f"{r.date[:4]}-{r.date[4:6]}-{r.date[6:8]}T{r.date[8:10]}:{r.date[10:12]}:{r.date[12:14]}Z"
    kind = "revisit" if revisit else "response" if head else "resource"
    lines = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(r.url, r.date, digest),
        "WARC-Date": iso,
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Block-Digest": "sha1:" + hashlib.sha1(block).hexdigest(),
        "WARC-Payload-Digest": "sha1:" + digest,
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response" if head else r.content_type,
    } | more | ({"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if revisit else {})
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode("utf-8", "surrogateescape") + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a file of gzip members; checks declared lengths and block digests.

    A member is fed STEP bytes at a time, so that what follows it is not copied for each record.
    """
    view, at_file = memoryview(data), 0
    while at_file < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at_file >= len(view):
                raise ValueError("a record breaks off")
            fed = view[at_file : at_file + STEP]
            parts.append(member.decompress(fed))
            at_file += len(fed) - len(member.unused_data)
        record = b"".join(parts)
        at = record.index(b"\r\n\r\n")
        version, *lines = record[:at].decode("utf-8", "surrogateescape").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        block = record[at + 4 : at + 4 + int(fields["Content-Length"])]
        if not version.startswith("WARC/") or record[at + 4 + len(block) :] != b"\r\n\r\n" or "sha1:" + hashlib.sha1(block).hexdigest() != fields["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
        yield fields, block


def _url(url: str | None) -> str:
    return re.sub(r"\s", "%20", url or "") or "about:blank"


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
_DATE = "20240101000000"


def _write(folder: str):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held, size, names, counts, n = [], 0, [], [], 0

        def flush():
            nonlocal held, size, n
            if held:
                names.append(name := f"{uuid.uuid4().hex}.warc.gz")
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(b"".join(held))
                counts.append(n)
                held, size, n = [], 0, 0

        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("page_id", "url", "html", "original")]
            for version in FIELDS:  # legacy archives of either version, one for half of the batch
                rows = [r for i, r in enumerate(zip(*cols, strict=True)) if i % len(FIELDS) + 1 == version]
                arc = write_arc([ArcRecord(_url(u), "0.0.0.0", _DATE, "text/html", _HTTP + (h or "").encode(), {}) for _, u, h, _ in rows], version)
                for (page, _, _, original), r in zip(rows, read_arc(arc), strict=True):
                    more = {"X-Page-ID": "" if page is None else str(page)}
                    if original is not None:
                        more |= {"WARC-Refers-To-Target-URI": _url(original["url"]), "WARC-Refers-To-Date": "2024-01-01T00:00:00Z", "WARC-Refers-To": record_id(_url(original["url"]), _DATE, hashlib.sha1(split_http(r.body)[1]).hexdigest()), "X-Refers-To-Page": str(original["page_id"])}
                    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                    held.append(deflate.compress(to_warc(r, more, original is not None)) + deflate.flush())
                    size, n = size + len(held[-1]), n + 1
                if size >= ARCHIVE_BYTES:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["name", "records"])

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page to archives in a folder; (name, records) of those that count."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    # The largest page_id of each payload; partial maxima leave one row a payload and task.
    largest = rows.select("page_id", "url", "digest", "size").filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n")).filter("n > 1").select("digest", "size", "last")
    largest = common.materialize(largest)
    small = largest.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("last.url")), F.lit(0))).first()
    joined = rows.join(F.broadcast(largest) if small[0] <= BROADCAST_ROWS and small[1] <= 200 * BROADCAST_ROWS else largest, ["digest", "size"], "left")
    original = F.when(F.col("last").isNotNull() & ~F.col("last.page_id").eqNullSafe(F.col("page_id")), F.col("last"))
    common.text_batches(pages.sparkSession)
    return common.materialize(joined.select("page_id", "url", "html", original.alias("original")).mapInArrow(_write(folder), "name string, records long"))


def _read(batches):
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for fields, _ in read_warc(content.as_py()):
                back = fields.get("X-Refers-To-Page")
                rows.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], int(back) if back and back != "None" else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"]))
            cols = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url"])


def read_archives(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """One row per record of the named archives."""
    common.text_batches(spark)  # a batch ends with the first archive, which is up to ARCHIVE_BYTES and a record long
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    names = F.broadcast(names.select("name")) if names.count() <= BROADCAST_ROWS else names.select("name")
    return files.join(names, "name", "left_semi").select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string")


def convert(pages: DataFrame) -> DataFrame:
    """Archives all pages and reads the archives back."""
    spark, folder = pages.sparkSession, common.shared_dir(pages.sparkSession)
    names = write_archives(pages, folder)
    if names.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string")
    return read_archives(spark, folder, names)
