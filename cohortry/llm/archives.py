"""Legacy ARC archives to WARC.

An ARC file begins with a version block (``filedesc://``) that names the version and so the fields of every later header
line: five in version 1, ten in version 2. A header line declares the length of the bytes that follow. The converter walks
a file by these lengths alone, and synthesises what WARC wants and ARC lacks: record ids (a name-based UUID of archive
name and offset, so a repeated task writes the same ones), ISO dates, record types and SHA-1 digests.

Archives are gzip files in folders, written by Spark's text writer with the record's bytes as its value, so the usual
commit protocol holds on any file system. A file is as large as one input split; readers unpack it as a stream.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import new_path, written

# The fields of a header line by version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: An address may hold blanks, a content type too; the fields around them decide.
_LINE = {
    1: re.compile(rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{12,14}) (?P<type>.+) (?P<length>\d+)"),
    2: re.compile(rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{12,14}) (?P<type>.+) (?P<result>\d+|-) (?P<checksum>\S+) "
                  rb"(?P<location>.+) (?P<offset>\d+) (?P<filename>\S+) (?P<length>\d+)"),
}
#: The page's id rides in this field of the HTTP head.
KEY_FIELD = "X-Page-Id"
CAPTURED = "20000101000000"
MIN_PAYLOAD = 0
#: Groups of copies above ``rows / HOT_SHARE`` are fewer than ``HOT_SHARE``, so their heads may be broadcast.
HOT_SHARE = 10_000
_BATCH_BYTES = 8 << 20
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(archive: str, offset: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{offset}").urn


def iso_date(stamp: str, otherwise: str) -> str:
    """``YYYYMMDDhhmm[ss]`` as an ISO date; a date that does not exist gives ``otherwise``."""
    try:
        return datetime.strptime(stamp.ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return otherwise


def opened(content: bytes) -> io.BufferedReader:
    """The archive's bytes as a stream; any number of gzip members, or none."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, 1 << 16)


def _exactly(stream: io.BufferedReader, length: int, what: str) -> bytes:
    data = stream.read(length)
    if len(data) < length:
        raise ValueError(f"{what} ends after {len(data)} of its declared {length} bytes")
    return data


# ------------------------------------------------------------------ writing ARC


def version_block(name: str, version: int, date: str = CAPTURED) -> bytes:
    body = f"{version} 0 cohortry\n{FIELDS[version]}\n".encode()
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, offset: int, url: str | None, content: bytes, date: str = CAPTURED,
               mime: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    address = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "-")
    middle = "" if version == 1 else f" 200 {hashlib.md5(content).hexdigest()} - {offset} {name}"
    return f"{address} {ip} {date} {mime}{middle} {len(content)}\n".encode() + content


def http_content(page_id: int | None, payload: bytes) -> bytes:
    key = "" if page_id is None else f"{KEY_FIELD}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{key}\r\n".encode() + payload


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, width) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``_BATCH_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += width(row) + 200
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _arc_rows(batches: Iterator[pa.RecordBatch], versions: Sequence[int]) -> Iterator[tuple[bytes]]:
    part = TaskContext.get().partitionId()
    version, name, offset = versions[part % len(versions)], f"pages-{part:05d}.arc", 0
    for batch in batches:
        for page_id, url, html in zip(*(batch.column(k) for k in range(3))):
            if not offset:
                block = version_block(name, version)
                yield (block,)
                offset = len(block) + 1
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            record = arc_record(version, name, offset, url.as_py(), http_content(page_id.as_py(), payload))
            yield (record,)
            offset += len(record) + 1


_BYTES = pa.schema([("record", pa.binary())])


def _write(records: DataFrame, path: str, separator: str) -> None:
    """One gzip file a task; the text writer passes the bytes on as they are."""
    (records.select(F.col("record").cast("string").alias("value")).write
     .option("compression", "gzip").option("lineSep", separator).text(path))


def write_arc(pages: DataFrame, path: str, versions: Sequence[int] = (1, 2)) -> None:
    """Pages as ARC files, one a task, the files taking turns through ``versions``.

    A NULL html is an empty payload, a NULL or empty url the address ``-``; blanks and control characters of an address
    are percent-encoded. Rows with a NULL page_id have no key field.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    records = rows.mapInArrow(
        lambda it: _in_batches(_arc_rows(it, versions), _BYTES, lambda r: len(r[0])), "record binary")
    _write(records, path, "\n")


# ------------------------------------------------------------------ reading ARC


def arc_records(content: bytes) -> Iterator[dict]:
    """Every record of an ARC file: its header's fields, its content, and the archive's name, date and offset."""
    stream, offset, version, name, date = opened(content), 0, None, "", ""
    while line := stream.readline():
        at, offset = offset, offset + len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        if version is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError("an ARC file begins with a filedesc:// record")
            length = int(line.rsplit(b" ", 1)[1])
            body = _exactly(stream, length, "version block")
            version = int(body.split(b" ", 1)[0])
            if version not in _LINE:
                raise ValueError(f"ARC version {version} is not known")
            found = _LINE[version].fullmatch(line)
            if not found:
                raise ValueError(f"version block of another version: {line[:200]!r}")
            name = found["url"].decode("utf-8", "replace").removeprefix("filedesc://")
            date = iso_date(found["date"].decode(), "1970-01-01T00:00:00Z")
        else:
            found = _LINE[version].fullmatch(line)
            if not found:
                raise ValueError(f"not a header line of version {version}: {line[:200]!r}")
            length = int(found["length"])
            body = _exactly(stream, length, "record")
        offset += length
        yield {k: v.decode("utf-8", "replace") for k, v in found.groupdict().items()} | {
            "content": body, "archive": name, "archive_date": date, "offset": at, "version": version}


def http_head(content: bytes) -> int:
    """Bytes of the HTTP head with its empty line; 0 without one."""
    if not content.startswith(b"HTTP/"):
        return 0
    ends = [at + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := content.find(mark, 0, 1 << 20)) >= 0]
    return min(ends, default=len(content))


def head_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)[ \t]*\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def _key(head: bytes) -> int | None:
    value = head_field(head, KEY_FIELD)
    return int(value) if value and re.fullmatch(r"-?\d{1,19}", value) else None


def _warc_type(record: dict, head: int) -> str:
    if record["url"].startswith("filedesc://"):
        return "warcinfo"
    return "response" if head else "resource"


_INDEX = "record_id string, warc_type string, page_id long, payload_bytes long, payload_digest string, date string"
_RECORD = (_INDEX + ", warcinfo_id string, url string, ip string, mime string, head_bytes int, block_digest string, "
           "head_digest string, block binary")
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _converted(batches: Iterator[pa.RecordBatch], blocks: bool) -> Iterator[tuple]:
    for batch in batches:
        for row in range(batch.num_rows):
            for r in arc_records(batch.column(0)[row].as_py()):
                content = r["content"]
                head = http_head(content)
                payload = content[head:]
                out = (record_urn(r["archive"], r["offset"]), _warc_type(r, head), _key(content[:head]), len(payload),
                       sha1_base32(payload), iso_date(r["date"], r["archive_date"]))
                if blocks:
                    out += (record_urn(r["archive"], 0), r["url"], r["ip"], r["type"], head, sha1_base32(content),
                            sha1_base32(content[:head]), content)
                yield out


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row a record of the ARC files in ``path``, in WARC terms; ``blocks=False`` leaves out the bytes.

    A malformed header line, an unknown version or a record that ends before its declared length is an error. An empty
    file has no records. A date that does not exist becomes the archive's.
    """
    ddl = _RECORD if blocks else _INDEX
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        lambda it: _in_batches(_converted(it, blocks), _schema(ddl), lambda r: len(r[-1]) if blocks else 0), ddl)


# ------------------------------------------------------------------ copies


def revisits(index: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """record_id, refers_to_id, refers_to and refers_to_date of every response that repeats another's payload.

    Of equal payloads the response with the largest (page_id, record_id) stands, NULL ids below all others. Heads of the
    groups are aggregated first; those of hot groups, fewer than ``HOT_SHARE``, are broadcast and their members never
    shuffled by payload.
    """
    rows = index.filter((F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_payload))
    heads = written(rows.groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "record_id", "date")).alias("head"),
    ).filter("n > 1"), "payload-heads")
    hot_from = max(HOT_SHARE, rows.count() // HOT_SHARE)
    hot = F.broadcast(heads.filter(F.col("n") > hot_from))
    apart = rows.join(hot, "payload_digest", "left_anti").join(heads.filter(F.col("n") <= hot_from), "payload_digest")
    found = apart.unionByName(rows.join(hot, "payload_digest"))
    return found.filter(F.col("record_id") != F.col("head.record_id")).select(
        "record_id", F.col("head.record_id").alias("refers_to_id"), F.col("head.page_id").alias("refers_to"),
        F.col("head.date").alias("refers_to_date"))


# ------------------------------------------------------------------ WARC


def _field(name: str, value: Column) -> Column:
    """A header line, or NULL for a NULL value."""
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def warc_record(refers: Column) -> Column:
    """The bytes of a WARC record; ``refers`` tells whether it is a revisit, which keeps only the HTTP head."""
    kind = F.col("warc_type")
    block = F.when(refers, F.expr("substring(block, 1, head_bytes)")).otherwise(F.col("block"))
    with_http = F.col("head_bytes") > 0
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        _field("WARC-Type", F.when(refers, F.lit("revisit")).otherwise(kind)),
        _field("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        _field("WARC-Date", F.col("date")),
        _field("WARC-Target-URI", F.when(kind != "warcinfo", F.col("url"))),
        _field("WARC-Filename", F.when(kind == "warcinfo", F.expr("substring(url, 12)"))),
        _field("WARC-IP-Address", F.when((kind != "warcinfo") & F.col("ip").rlike(r"[1-9]"), F.col("ip"))),
        _field("WARC-Warcinfo-ID", F.when(kind != "warcinfo", F.concat(F.lit("<"), F.col("warcinfo_id"), F.lit(">")))),
        _field("WARC-Profile", F.when(refers, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_id"), F.lit(">"))),
        _field("WARC-Refers-To-Date", F.col("refers_to_date")),
        _field("X-Refers-To-Page-Id", F.col("refers_to")),
        _field("X-Payload-Length", F.col("payload_bytes")),
        _field("WARC-Block-Digest", F.concat(
            F.lit("sha1:"), F.when(refers, F.col("head_digest")).otherwise(F.col("block_digest")))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _field("Content-Type", F.when(kind == "warcinfo", F.lit("text/plain"))
               .when(with_http, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))),
        _field("Content-Length", F.octet_length(block)),
    )
    return F.concat(F.concat(lines, F.lit("\r\n\r\n")).cast("binary"), block)


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """The ARC files of one folder as WARC files of another, one record each.

    The version block becomes a warcinfo record, content with an HTTP head a response, other content a resource.
    Responses whose payload stands elsewhere become revisits. The files are read twice: for the index of ids and digests,
    then for the records, which take the decisions by their unique id; only Spark's size check of the written decisions
    makes that a broadcast.
    """
    index = written(read_arc(spark, arc_path, blocks=False), "arc-index")
    decisions = written(revisits(index, min_payload), "revisits")
    records = read_arc(spark, arc_path).join(decisions, "record_id", "left")
    _write(records.select(warc_record(F.col("refers_to_id").isNotNull()).alias("record")), warc_path, "\r\n\r\n")


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of every record of a WARC file."""
    stream = opened(content)
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC version line: {line[:200]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, _exactly(stream, int(fields["content-length"]), "record")


_READ = ("record_id string, record_type string, url string, date string, page_id long, payload_bytes long, "
         "payload_digest string, refers_to_id string, refers_to long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in range(batch.num_rows):
            for fields, block in warc_records(batch.column(0)[row].as_py()):
                kind, head = fields["warc-type"], http_head(block)
                length, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-block-digest"] != "sha1:" + sha1_base32(block):
                    raise ValueError(f"block digest of {fields['warc-record-id']} differs")
                if kind != "revisit" and (length, digest) != (len(block) - head, sha1_base32(block[head:])):
                    raise ValueError(f"payload of {fields['warc-record-id']} differs")
                refers = fields.get("x-refers-to-page-id")
                yield (fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), fields["warc-date"],
                       _key(block[:head]), length, digest, (fields.get("warc-refers-to") or "").strip("<>") or None,
                       int(refers) if refers else None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the WARC files in ``path``; digests and lengths of whole payloads are computed anew and must
    agree with the header."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda it: _in_batches(_read_back(it), _schema(_READ), lambda r: 0), _READ)


def archived(pages: DataFrame, path: str | None = None, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Pages through ARC into WARC files (below ``path`` or a new shared folder), read back: one row a page.

    A repeated page_id keeps a record per row; of its equal payloads one is the response. An empty table gives no rows.
    """
    spark, path = pages.sparkSession, path or new_path(pages.sparkSession, "archives")
    write_arc(pages, f"{path}/arc")
    convert(spark, f"{path}/arc", f"{path}/warc", min_payload)
    return read_warc(spark, f"{path}/warc").filter(F.col("record_type") != "warcinfo")
