"""WARC archives: one gzip member per record, revisit records for repeated payloads."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import blocks, spread
from podium.llm.files import new_file, open_file
from podium.session import new_folder, ship_package

#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 64_000_000
READ_BYTES = 65_536
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # pages carry no date


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as archives have it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str | None) -> str:
    """A header value: no line breaks or other control characters in it."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_line(url)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += [f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


class WarcError(ValueError):
    """An archive that is cut short or does not hold what its headers say."""


@dataclass
class Record:
    headers: dict[str, str]  # names in lower case
    http: dict[str, str]
    payload: bytes


class _Members:
    """The bytes of one gzip member after the other, unpacked as far as they are asked for."""

    def __init__(self, stream):
        self.stream, self.packed, self.plain, self.unpacker = stream, b"", bytearray(), None

    def begin(self) -> bool:
        """Go on to the next member; false at the end of the archive."""
        self.packed = self.packed or self.stream.read(READ_BYTES)
        self.plain, self.unpacker = bytearray(), zlib.decompressobj(31)
        return bool(self.packed)

    def more(self) -> bool:
        """Unpack a little more of the member; false at its end."""
        if self.unpacker.eof:
            return False
        self.packed = self.packed or self.stream.read(READ_BYTES)
        if not self.packed:
            raise WarcError("the archive ends inside a record")
        try:
            self.plain += self.unpacker.decompress(self.packed, READ_BYTES * 4)
        except zlib.error as bad:
            raise WarcError(f"not a gzip member: {bad}") from bad
        self.packed = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.plain.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.plain)
            if not self.more():
                raise WarcError("a header without its end")
        found = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self.more():
                raise WarcError("a record is shorter than its content length")
        found = bytes(self.plain[:n])
        del self.plain[:n]
        return found

    def rest(self) -> bytes:
        while self.more():
            pass
        return bytes(self.plain)


def _fields(text: bytes, first: str) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"{lines[0][:40]!r} where {first} should be")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def read_records(stream) -> Iterator[Record]:
    """The records of an archive in order; lengths and digests are verified. Holds one record at a time."""
    members = _Members(stream)
    while members.begin():
        headers = _fields(members.until(b"\r\n\r\n"), "WARC/")
        if not headers.get("content-length", "").isdigit():
            raise WarcError("a record without a content length")
        block = members.take(int(headers["content-length"]))
        if members.rest() != b"\r\n\r\n":
            raise WarcError("a record is longer than its content length")
        if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
            raise WarcError("a record whose block has another digest")
        http, payload = {}, block
        if headers.get("content-type", "").startswith("application/http"):
            head, mark, payload = block.partition(b"\r\n\r\n")
            if not mark:
                raise WarcError("an HTTP head without its end")
            http = _fields(head, "HTTP/")
        if headers.get("warc-type") != "revisit":
            if headers.get("warc-payload-digest", f"sha1:{digest(payload)}") != f"sha1:{digest(payload)}":
                raise WarcError("a record whose payload has another digest")
            if http.get("content-length", str(len(payload))) != str(len(payload)):
                raise WarcError("a payload of another length than its HTTP head says")
        elif payload:
            raise WarcError("a revisit with a payload")
        yield Record(headers, http, payload)


def _number(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html); the list of archives is returned.

    Of equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is a
    response and the others are revisits of it; a null html is an empty payload. A row without a
    page_id is a revisit if the payload has one with a page_id; rows that repeat the largest page_id are all responses.
    An empty table gives an empty list; other columns are ignored. The list (folder, file,
    n_records) is stored, so archives are written once.
    """
    spark = pages.sparkSession
    ship_package(spark)
    folder = folder or new_folder(spark, "warc")
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    single = rows.where(F.length("html") < least_bytes).withColumn("first", F.lit(None).cast("long"))
    rows = rows.where(F.length("html") >= least_bytes)
    rows = rows.withColumn("key", F.concat(F.sha1("html"), F.sha2("html", 256)))
    largest = rows.groupBy("key").agg(F.max("page_id").alias("first"))
    rows = rows.join(largest, "key").select("page_id", "url", "html", "first")
    rows = rows.unionByName(single) if least_bytes else rows

    def write(batches):
        waiting = (row for batch in blocks(batches, "html", 8_000_000) for row in batch.to_pylist())
        row = next(waiting, None)
        while row is not None:
            n = 0
            with new_file(folder, "warc.gz") as (name, stream):
                while row is not None and stream.tell() < ARCHIVE_BYTES:
                    revisit = row["first"] is not None and row["first"] != row["page_id"]
                    stream.write(record(row["page_id"], row["url"], row["html"], row["first"], revisit))
                    n, row = n + 1, next(waiting, None)
            yield pa.RecordBatch.from_pylist([{"folder": folder, "file": name, "n_records": n}], schema=listed)

    listed = pa.schema([("folder", pa.string()), ("file", pa.string()), ("n_records", pa.int64())])
    path = new_folder(spark, "warc-files")
    rows.mapInArrow(write, "folder string, file string, n_records long").write.parquet(path)
    return spark.read.parquet(path)


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload.

    Bytes and digest are those of the full payload; a revisit has them in its headers, and no payload.
    """
    ship_package(files.sparkSession)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
    kinds |= {"record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if with_payload else {})
    schema = pa.schema(list(kinds.items()))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out, held = [], 0
                with open_file(row["folder"], row["file"]) as stream:
                    for r in read_records(stream):
                        out.append(
                            {
                                "page_id": _number(r.headers["warc-record-id"]),
                                "url": r.headers["warc-target-uri"],
                                "payload_bytes": int(r.http["content-length"]),
                                "payload_digest": r.headers["warc-payload-digest"].removeprefix("sha1:"),
                                "record_type": r.headers["warc-type"],
                                "refers_to": _number(r.headers.get("warc-refers-to", "")),
                                "payload": r.payload,
                            }
                        )
                        held += len(r.payload) * with_payload
                        if len(out) == 2000 or held > 8_000_000:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spread(files.select("folder", "file"), "file").mapInArrow(read, shape + ", payload binary" * with_payload)
