"""WARC archives of Zstandard frames: writer and reader.

An archive begins with a skippable frame that holds the compression dictionary;
each record is a frame of its own. Spark's text writer puts the frames down, so
archives are committed like any other output on any file system it knows. Its
line separator is an empty skippable frame, which every decoder steps over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renderscope.session import shared_folder

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGICS = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_SKIPPABLE = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads that the dictionary of an archive is trained on: the first of it, up to so many bytes.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
LEAST_REVISIT = 1000
#: Records are handed to Spark in batches of about so many bytes.
BATCH_BYTES = 8 << 20


class BadArchive(ValueError):
    """An archive, header or length that does not hold what it should."""


# --- records -----------------------------------------------------------------


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str
) -> bytes:
    """One record. A revisit leaves its payload out and keeps the length in its HTTP header."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"{what} header line {line[:80]!r}")
        out[name.decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _length(fields: dict[str, str], what: str) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", value):
        raise BadArchive(f"{what} has Content-Length {value!r}")
    return int(value)


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+|none)>", value or "")
    if not m:
        raise BadArchive(f"record id {value!r}")
    return None if m[1] == "none" else int(m[1])


def parse_record(data: bytes) -> dict:
    """The record in one frame, with headers, lengths and digest checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not re.match(rb"WARC/1\.[01](\r\n|$)", head):
        raise BadArchive("no WARC header")
    fields = _fields(head, "WARC")
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if name not in fields:
            raise BadArchive(f"{name} is missing")
    size = _length(fields, "the record")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"a block of {len(rest) - 4} bytes where the header says {size}")
    block = rest[:size]
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return {"record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload": block}
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise BadArchive("no HTTP header")
    length = _length(_fields(http, "HTTP"), "the response")
    m = re.fullmatch(r"sha1:([A-Z2-7]{32})", fields.get("warc-payload-digest", ""))
    if not m:
        raise BadArchive("no payload digest")
    digest = base64.b32decode(m[1]).hex()
    refers_to = None
    if kind == "response":
        if len(payload) != length:
            raise BadArchive(f"a payload of {len(payload)} bytes where the header says {length}")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise BadArchive("the payload does not have its digest")
    else:
        if payload or fields.get("warc-profile") != REVISIT_PROFILE:
            raise BadArchive("a revisit with a payload or of another profile")
        refers_to = _page(fields.get("warc-refers-to"))
    return {
        "page_id": _page(fields["warc-record-id"]),
        "target_uri": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": refers_to,
        "payload": payload if kind == "response" else None,
    }


# --- frames ------------------------------------------------------------------


def skippable(content: bytes, magic: int = DICTIONARY_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def trained_dictionary(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for records like these; none where there is too little to learn from."""
    if len(sample) < 8 or sum(map(len, sample)) < 8 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
    except zstandard.ZstdError:
        return None


def frames_of(archive) -> Iterator[bytes]:
    """Record by record, the decoded frames of an archive; one record in memory at a time."""
    view = memoryview(archive)
    at, first, dictionary = 0, True, None
    while at < len(view):
        if len(view) - at < 4:
            raise BadArchive("bytes left over at the end")
        magic = struct.unpack_from("<I", view, at)[0]
        if magic in SKIPPABLE_MAGICS:
            if len(view) - at < 8:
                raise BadArchive("a skippable frame is cut off")
            size = struct.unpack_from("<I", view, at + 4)[0]
            if len(view) - at - 8 < size:
                raise BadArchive("a skippable frame is cut off")
            if first and magic == DICTIONARY_MAGIC and size:
                content = bytes(view[at + 8 : at + 8 + size])
                if struct.unpack_from("<I", content)[0] == FRAME_MAGIC:
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
            at += 8 + size
        elif magic == FRAME_MAGIC:
            decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
            parts, step = [], 1 << 16
            frame = decoder.decompressobj()
            try:
                while not frame.eof and at < len(view):
                    piece = view[at : at + step]
                    parts.append(frame.decompress(piece))
                    at += len(piece)
            except zstandard.ZstdError as e:
                raise BadArchive(f"a frame can't be decoded: {e}") from e
            if not frame.eof:
                raise BadArchive("a frame is cut off")
            at -= len(frame.unused_data)
            yield b"".join(parts)
        else:
            raise BadArchive(f"no frame begins with {magic:#x}")
        first = False


# --- Spark -------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to.

    Of equal payloads of at least ``least`` bytes the largest page_id is the
    response and the others revisit it; rows that repeat that id are responses
    too. Rows without page_id are always responses. Only digests are shuffled
    for the groups.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumns({"payload_digest": F.sha1("payload"), "check": F.sha2("payload", 256)})
    thin = rows.filter((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
    newest = (
        thin.select("page_id", "payload_digest", "check")
        .groupBy("payload_digest", "check")
        .agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    long_enough = (F.octet_length("payload") >= least) & F.col("page_id").isNotNull()
    revisit = long_enough & (F.col("page_id") < F.col("newest"))
    return rows.join(newest, ["payload_digest", "check"], "left").select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("newest")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """One archive per partition of ``records`` (the columns of with_revisits)."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        held, encoder = 0, None

        def begin() -> list[bytes]:
            nonlocal encoder
            dictionary = trained_dictionary(waiting)
            encoder = zstandard.ZstdCompressor(
                level=LEVEL, write_checksum=True, write_content_size=True, **({"dict_data": dictionary} if dictionary else {})
            )
            head = [skippable(dictionary.as_bytes())] if dictionary else []
            out = head + [encoder.compress(x) for x in waiting]
            waiting.clear()
            return out

        def batch(frames: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

        ready: list[bytes] = []
        size = 0
        for rows in batches:
            for i in range(rows.num_rows):
                row = {n: rows.column(j)[i].as_py() for j, n in enumerate(rows.schema.names)}
                data = record_bytes(
                    row["page_id"], row["url"], row["payload"], row["payload_digest"], row["record_type"], row["refers_to"], date
                )
                if encoder is None:
                    waiting.append(data)
                    held += len(data)
                    if held >= SAMPLE_BYTES:
                        ready += begin()
                else:
                    ready.append(encoder.compress(data))
                    size += len(ready[-1])
                if size >= BATCH_BYTES:
                    yield batch(ready)
                    ready, size = [], 0
        if waiting:
            ready += begin()
        if ready:
            yield batch(ready)

    frames = records.mapInArrow(archive, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_SKIPPABLE).text(folder)


RECORD = (
    "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary"
)


def read_archives(spark, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives in a folder; a bad header, length or digest fails the job.

    Records of other types keep type, target and block. Archives of up to 2 GB
    are read, each by one task, record by record.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for content in rows.column(0):
                out, size = [], 0
                for data in frames_of(content.as_buffer()):
                    record = parse_record(data)
                    size += len(data)
                    if not with_payload:
                        record["payload"] = None
                    out.append(record)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")
    return files.mapInArrow(records, RECORD)


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per page, read the archives back: one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.
    Null html is an empty payload, null url is about:blank; an empty table gives
    no rows; other columns are not looked at.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    write_archives(with_revisits(pages, least), folder)
    return read_archives(spark, folder, with_payload=False).drop("payload")
