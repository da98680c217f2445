"""Legacy archive conversion: ARC version 1 and 2 files to WARC 1.1, and a WARC reader.

An ARC file starts with a ``filedesc`` record whose version block names the URL-record fields; each record is one header
line with those fields, the last of which declares the length, then that many bytes and a newline.  The converter
follows the declared lengths only.  For each record it synthesises a WARC record: a name-based UUID as identifier, the
14-digit archive date as WARC-Date, the types ``warcinfo`` and ``response`` or ``revisit``, and SHA-1 payload and block
digests.  Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest key stays a response,
the others become revisits that name it; smaller payloads are never deduplicated.

Archives are written by Spark's text writer (gzip; the line separator is the record separator of the format) and read
as binary files, so they live in any store Spark reaches.  An archive ends after ``ARCHIVE_ROWS`` records, or after
``ARCHIVE_BYTES`` and the record that passes them (its last rows are then empty lines, which readers skip), so that none
comes near the 2 GiB a binary file may have, however a partition is dealt.  Equal payloads meet through a partial maximum
by digest; a payload held by a third of all records is one row there, and its join is a plain equi-join that the adaptive
planner can split.  Payloads too small to be referred to are dealt by record, not by digest.

Defined cases: null html is an empty payload; a null or blank url is ``-`` in ARC and no target in WARC; blanks and
control characters in a url are percent-encoded; a null page_id is written as none and read back as null, and revisits
the largest page_id of equal payloads if there is one; rows with equal page_id and payload are all responses if that
page_id is the largest; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import scratch_path, written

REVISIT_BYTES = 1000
DATE = "20240101000000"
ADDRESS = "0.0.0.0"
# The field lists of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ROW_HEADER = "X-Archive-Row"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
ARCHIVE_ROWS = 4096
ARCHIVE_BYTES = 1 << 28
#: How hard archives are compressed: zlib's level 3.
GZIP = {"compression": "gzip", "zlib.compress.level": "THREE"}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-conversion")


def _utf8(x: str) -> bytes:
    return x.encode("utf-8", "surrogatepass")


# --- ARC ------------------------------------------------------------------------------


def arc_header(version: int, url: str, length: int, mime: str, name: str, status: str = "200", sum_: str = "-") -> str:
    values = {
        "URL": url, "IP-address": ADDRESS, "Archive-date": DATE, "Content-type": mime, "Result-code": status, "Checksum": sum_,
        "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(length),
    }
    return " ".join(values[f] for f in FIELDS[version].split())


def filedesc(version: int, name: str) -> str:
    block = f"{version} 0 Archive\n{FIELDS[version]}\n"
    return f"{arc_header(version, 'filedesc://' + name, len(block), 'text/plain', name)}\n{block}"


class Archive:
    """What the writer's present file holds; Spark's writer begins another after ``ARCHIVE_ROWS`` rows."""

    def __init__(self) -> None:
        self.number = self.rows = self.bytes = 0

    def opens(self) -> bool:
        return not self.rows

    def add(self, record: str | bytes) -> list:
        """The rows to write for a record: itself, and empty ones that fill up an archive which has its size."""
        self.rows, self.bytes = self.rows + 1, self.bytes + len(record)
        fill = ARCHIVE_ROWS - self.rows if self.bytes >= ARCHIVE_BYTES else 0
        if self.rows + fill >= ARCHIVE_ROWS:
            self.number, self.rows, self.bytes = self.number + 1, 0, 0
        return [record, *[record[:0]] * fill]


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    version, archive = 1 + part % 2, Archive()
    for batch in batches:
        out = []
        for key, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            if archive.opens():
                name = f"pages-{part:06d}-{archive.number:06d}.arc"
                out += archive.add(filedesc(version, name))
            body = html or ""
            size = len(_utf8(body))
            row = "" if key is None else f"{ROW_HEADER}: {key}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{row}Content-Length: {size}\r\n\r\n"
            url = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
            out += archive.add(f"{arc_header(version, url, len(head) + size, 'text/html', name)}\n{head}{body}")
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_arc(pages: DataFrame, path: str) -> None:
    """ARC archives of pages (page_id, url, html): version 1 and 2 in turn, gzip files of bounded size."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    records = rows.mapInArrow(_arc_records, "value string")
    records.write.options(lineSep="\n", maxRecordsPerFile=ARCHIVE_ROWS, **GZIP).text(path)


class Blocks:
    """Bytes of an archive (gzip members or plain), inflated piece by piece as they are asked for."""

    def __init__(self, content: bytes):
        self.raw, self.at, self.ready, self.pos = memoryview(content), 0, b"", 0
        self.unzip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        if self.unzip is None:
            new = bytes(piece)
        else:
            new = self.unzip.decompress(piece)
            while self.unzip.eof and self.unzip.unused_data:  # the next member
                rest, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
                new += self.unzip.decompress(rest)
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
        self.ready, self.pos = self.ready[self.pos :] + new, 0
        return True

    def line(self) -> bytes | None:
        """Up to the next newline, without it; None at the end."""
        while (end := self.ready.find(b"\n", self.pos)) < 0:
            if not self._more():
                return None
        out, self.pos = self.ready[self.pos : end], end + 1
        return out

    def take(self, n: int) -> bytes:
        if len(self.ready) - self.pos < n:
            parts, have = [self.ready[self.pos :]], len(self.ready) - self.pos
            self.ready, self.pos = b"", 0
            while have < n and self._more():
                parts.append(self.ready)
                have += len(self.ready)
                self.ready = b""
            self.ready = b"".join(parts)
            if len(self.ready) < n:
                raise ValueError(f"archive ends {n - len(self.ready)} bytes before a declared length")
        out, self.pos = self.ready[self.pos : self.pos + n], self.pos + n
        return out


def read_arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(version, header fields, block) of each record after the filedesc; the header line follows the file's version."""
    blocks, version, fields = Blocks(content), 0, []
    while (line := blocks.line()) is not None:
        if not line.strip():  # separators between records
            continue
        parts = line.decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        length = int(parts[-1])
        block = blocks.take(length)
        if parts[0].startswith("filedesc://"):
            first, names = block.decode("ascii").split("\n")[:2]
            version, fields = int(first.split(" ")[0]), names.split(" ")
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            continue
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} fields in a version {version} header line, {len(fields)} are declared")
        yield version, dict(zip(fields, parts)), block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its blank line) and payload; a block without one is payload only."""
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if block.startswith(b"HTTP/") and end >= 0 else (b"", block)


def _header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name).encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "surrogatepass") if found else None


def _arc_rows(content: bytes) -> Iterator[tuple[tuple, bytes]]:
    for version, f, block in read_arc_records(content):
        head, payload = split_http(block)
        row = _header_value(head, ROW_HEADER)
        yield (int(row) if row else None, f["URL"], f["Archive-date"], f["Content-type"], version, len(payload), hashlib.sha1(payload).digest()), block


_TYPES = {"row_key": pa.int64(), "version": pa.int32(), "payload_bytes": pa.int64(), "payload_sha1": pa.binary(), "block": pa.binary(), "refers_key": pa.int64()}


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, _TYPES.get(n, pa.string())) for n, x in zip(names, zip(*rows))], names=names)


def _reader(rows_of, names: list[str], blocks: bool):
    """mapInArrow function over whole archives; a batch leaves after 4 MB of blocks."""
    names = [*names, "block"] if blocks else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out, held = [], 0
                for row, block in rows_of(content.as_py()):
                    out.append((*row, block) if blocks else row)
                    held += len(block) if blocks else 400
                    if held > 1 << 22:
                        yield _rows(out, names)
                        out, held = [], 0
                if out:
                    yield _rows(out, names)

    return run


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The archive files below a path, whole (none is large)."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of ARC archives; without ``blocks`` only what their headers and digests say."""
    names = ["row_key", "url", "archive_date", "mime", "version", "payload_bytes", "payload_sha1"]
    schema = "row_key long, url string, archive_date string, mime string, version int, payload_bytes long, payload_sha1 binary"
    return archives(spark, path).mapInArrow(_reader(_arc_rows, names, blocks), schema + (", block binary" if blocks else ""))


# --- conversion -------------------------------------------------------------------------


def record_id(row_key: int | None, url: str, date: str, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{row_key} {date} {sha1.hex()} {url}')}>"


def _warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _sha1_name(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(kind: str, ident: str, date: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), *more]
    head += [("WARC-Block-Digest", _sha1_name(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    return _utf8("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n") + block


def _warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ("row_key", "url", "archive_date", "mime", "version", "payload_sha1", "block", "refers_key", "refers_url", "refers_date")
    archive = Archive()
    for batch in batches:
        out = []
        for key, url, date, mime, version, sha1, block, to, to_url, to_date in zip(*(batch.column(c).to_pylist() for c in columns)):
            if archive.opens():
                info = b"software: ARC to WARC conversion\r\nformat: WARC File Format 1.1\r\n"
                ident = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'info {key} {url} {date}')}>"
                out += archive.add(warc_record("warcinfo", ident, _warc_date(date), info, [("Content-Type", "application/warc-fields")]))
            more = [("WARC-Target-URI", url)] if url != "-" else []
            more += [("WARC-IP-Address", ADDRESS), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _sha1_name(sha1))]
            more += [("WARC-Identified-Payload-Type", mime), ("WARC-Converted-From", f"ARC/{version}")]
            kind = "response" if to is None else "revisit"
            if to is not None:
                more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                more += [("WARC-Refers-To", record_id(to, to_url, to_date, sha1)), ("WARC-Refers-To-Date", _warc_date(to_date))]
                more += [("WARC-Refers-To-Target-URI", to_url)] if to_url != "-" else []
                block = split_http(block)[0]  # the payload stands in the record referred to
            out += archive.add(warc_record(kind, record_id(key, url, date, sha1), _warc_date(date), block, more))
        for i in range(0, len(out), 500):
            yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 500], pa.binary())], names=["record"])


def convert(spark: SparkSession, arc_path: str, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write the records of the ARC archives below ``arc_path`` as WARC archives below ``path``."""
    arc = read_arc(spark, arc_path)
    same = read_arc(spark, arc_path, blocks=False).where(F.col("payload_bytes") >= revisit_bytes)
    # the largest key; of equal keys the first url and date
    first = F.min_by(F.struct("url", "archive_date"), F.struct(-F.col("row_key"), "url", "archive_date"))
    kept = same.where("row_key is not null").groupBy("payload_sha1").agg(
        F.max("row_key").alias("refers_key"), F.count(F.lit(1)).alias("_n"), first.alias("_first")
    )
    kept = kept.select(F.col("payload_sha1").alias("_sha1"), "refers_key", F.col("_first.url").alias("refers_url"), F.col("_first.archive_date").alias("refers_date"))
    # a small payload has no partner: a key of 8 bytes deals its records evenly
    alone = F.unhex(F.hex(F.xxhash64("row_key", "url", "archive_date")))
    key = F.when(F.col("payload_bytes") >= revisit_bytes, F.col("payload_sha1")).otherwise(alone)
    rows = arc.withColumn("_key", key).join(kept, F.col("_key") == F.col("_sha1"), "left").drop("_sha1", "_key")
    revisits = ~F.col("row_key").eqNullSafe(F.col("refers_key")) & F.col("refers_key").isNotNull()
    for c in ("refers_key", "refers_url", "refers_date"):
        rows = rows.withColumn(f"_{c}", F.when(revisits, F.col(c)))
    rows = rows.select("row_key", "url", "archive_date", "mime", "version", "payload_sha1", "block", *[F.col(f"_{c}").alias(c) for c in ("refers_key", "refers_url", "refers_date")])
    records = rows.mapInArrow(_warc_records, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.options(lineSep="\r\n\r\n", maxRecordsPerFile=ARCHIVE_ROWS, **GZIP).text(path)


# --- WARC reader ------------------------------------------------------------------------


def read_warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by the declared Content-Length."""
    blocks = Blocks(content)
    while (line := blocks.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not start with its version line")
        fields = {}
        while (line := blocks.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, blocks.take(int(fields["content-length"]))


def _warc_rows(content: bytes) -> Iterator[tuple[tuple, bytes]]:
    for f, block in read_warc_records(content):
        if f["warc-type"] == "warcinfo":
            continue
        head, payload = split_http(block)
        named = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:"))
        size = len(payload)
        if f["warc-type"] == "revisit":
            size = int(_header_value(head, "Content-Length") or 0)
        elif hashlib.sha1(payload).digest() != named:
            raise ValueError(f"payload of {f['warc-record-id']} differs from its digest")
        row = _header_value(head, ROW_HEADER)
        key = int(row) if row else None
        yield (f["warc-record-id"], f["warc-type"], f["warc-date"], f.get("warc-target-uri"), key, size, named, f.get("warc-refers-to")), block


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The response and revisit records of WARC archives; digests of stored payloads are checked."""
    names = ["record_id", "record_type", "date", "url", "row_key", "payload_bytes", "payload_sha1", "refers_to"]
    schema = "record_id string, record_type string, date string, url string, row_key long, payload_bytes long, payload_sha1 binary, refers_to string"
    return archives(spark, path).mapInArrow(_reader(_warc_rows, names, blocks), schema + (", block binary" if blocks else ""))


def convert_pages(pages: DataFrame) -> DataFrame:
    """Pages through ARC and WARC archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    rows = written(read_warc(spark, warc, blocks=False), "warc-index")
    named = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("row_key").alias("refers"))
    named = named.groupBy("refers_to").agg(F.max("refers").alias("refers"))
    return rows.join(named, "refers_to", "left").select(
        F.col("row_key").alias("page_id"), "payload_bytes", F.lower(F.hex("payload_sha1")).alias("payload_digest"), "record_type",
        F.col("refers").alias("refers_to"),
    )
