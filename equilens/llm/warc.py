"""WARC archives in Zstandard form: one frame per record, the dictionary in a leading skippable frame.

Writing goes through Spark's text sink and reading through its ``binaryFile`` source, so archives may lie in any
store that Spark reaches and a lost task is simply run again. The sink's line separator is an empty skippable frame,
which every Zstandard reader passes over.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm.common import shared_folder, small_batches

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC, SKIPPABLE_MASK = 0x184D2A50, 0xFFFFFFF0
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", SKIPPABLE_MAGIC, 0)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

RECORD = (
    "path string, offset long, warc_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, error string"
)


class Damaged(ValueError):
    """A frame or record that breaks the format; the text says how."""


def one_line(x: str) -> str:
    return x.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in x or "\n" in x else x


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION.decode(), *(f"{k}: {one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, kind: str, refers_to, digest: str, size: int, payload: bytes) -> bytes:
    """A response with its payload, or a revisit that names the response and keeps the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if kind == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return record_bytes(headers, block)


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary from the first records of an archive; empty where they are too few or too short to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def archives(records: Iterator[bytes], archive_bytes: int, dictionary_bytes: int, sample_bytes: int, level: int) -> Iterator[bytes]:
    """Whole archives of about ``archive_bytes`` at most: dictionary frame, then one frame per record.

    Memory holds one archive, ``sample_bytes`` of records before its dictionary is trained, and one record.
    """
    def opened(first: list[bytes]):
        raw = trained(first, dictionary_bytes)
        packed = zstandard.ZstdCompressor(level=19).compress(raw) if raw else b""
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed if raw else b""
        data = zstandard.ZstdCompressionDict(raw) if raw else None
        return [lead], zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True, write_checksum=True)

    waiting, held, out, size, press = [], 0, None, 0, None
    for record in records:
        if out is None:
            waiting.append(record)
            held += len(record)
            if held < sample_bytes:
                continue
            out, press = opened(waiting)
            todo, waiting, held, size = waiting, [], 0, len(out[0])
        else:
            todo = [record]
        for x in todo:
            out.append(press.compress(x))
            size += len(out[-1])
        if size >= archive_bytes:
            yield b"".join(out)
            out = None
    if waiting:
        out, press = opened(waiting)
        out += [press.compress(x) for x in waiting]
    if out is not None:
        yield b"".join(out)


def write_archives(
    records: DataFrame, path: str, archive_bytes: int = 32 << 20, dictionary_bytes: int = 32 << 10,
    sample_bytes: int = 2 << 20, level: int = 6,
) -> None:
    """Write rows (page_id, url, kind, refers_to, payload_digest, payload_bytes, payload binary) as archives, one
    file each. An empty table writes none. A null url has no header; a null page_id is an empty one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[bytes]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield page_record(
                        r["page_id"], r["url"], r["kind"], r["refers_to"], r["payload_digest"], r["payload_bytes"], r["payload"] or b"")

        for archive in archives(rows(), archive_bytes, dictionary_bytes, sample_bytes, level):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["archive"])

    small_batches(records.sparkSession)
    packed = records.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value"))
    packed.write.option("lineSep", EMPTY_FRAME.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def leading_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in the leading skippable frame, itself packed or plain, and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise Damaged(f"dictionary frame of {size} bytes in a file of {len(data)}")
    raw = bytes(data[8:8 + size])
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    return zstandard.ZstdCompressionDict(raw), 8 + size


def frames(data: memoryview, step: int = 1 << 16) -> Iterator[tuple[int, bytes | Damaged]]:
    """(offset, content) of each frame; a damaged frame is the last, since the next one can't be found."""
    try:
        known, at = leading_dictionary(data)
    except (Damaged, zstandard.ZstdError) as e:
        yield 0, Damaged(str(e))
        return
    unpack = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            yield at, Damaged(f"{len(data) - at} bytes after the last frame")
            return
        magic, size = struct.unpack_from("<II", data, at)
        if magic & SKIPPABLE_MASK == SKIPPABLE_MAGIC:
            if at + 8 + size > len(data):
                yield at, Damaged("skippable frame runs past the end")
                return
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            yield at, Damaged(f"no frame begins with {magic:#010x}")
            return
        one, out, end = unpack.decompressobj(), [], at
        try:
            while not one.eof and end < len(data):
                out.append(one.decompress(data[end:end + step]))
                end = min(end + step, len(data))
        except zstandard.ZstdError as e:
            yield at, Damaged(str(e))
            return
        if not one.eof:
            yield at, Damaged("the last frame is cut short")
            return
        yield at, b"".join(out)
        at = end - len(one.unused_data)


def parsed(record: bytes) -> dict:
    """Fields of one record, after checks of version, headers, lengths and digests."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (VERSION, b"WARC/1.0"):
        raise Damaged("no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip() or name != name.strip():
            raise Damaged(f"header line {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in REQUIRED:
        if name.lower() not in headers:
            raise Damaged(f"header {name} is missing")
    length = headers["content-length"]
    if not length.isascii() or not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise Damaged(f"Content-Length {length} with {len(rest) - 4} bytes of block")
    block = rest[:-4]
    kind, payload, size = headers["warc-type"], block, len(block)
    if "msgtype=response" in headers.get("content-type", ""):
        http, gap, payload = block.partition(b"\r\n\r\n")
        stated = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(stated[0]) if stated and stated[0].isdigit() else len(payload)
        if not gap or kind == "response" and size != len(payload):
            raise Damaged(f"HTTP head states {size} bytes, the payload has {len(payload)}")
    if kind == "revisit" and "warc-refers-to" not in headers:
        raise Damaged("a revisit without WARC-Refers-To")
    digest = headers.get("warc-payload-digest", "")
    for name, content in (("warc-block-digest", block), *([("warc-payload-digest", payload)] if kind == "response" else [])):
        if (value := headers.get(name, "")).startswith("sha256:") and hashlib.sha256(content).hexdigest() != value[7:]:
            raise Damaged(f"{name} differs")
    return {
        "warc_type": kind, "record_id": headers["warc-record-id"], "target_uri": headers.get("warc-target-uri"),
        "refers_to": headers.get("warc-refers-to"), "payload_digest": digest.removeprefix("sha256:") or None, "payload_bytes": size,
        "payload": payload if kind != "revisit" else None, "error": None,
    }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``path``, one row each (schema ``RECORD``).

    A record that fails a check is a row with its place and ``error`` set; after a damaged frame the rest of that
    file can't be found and the error says so. Archives must be below 2 GB each. ``payloads=False`` still checks
    payloads but leaves them out of the rows. A folder without archives gives no rows.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()),
            ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
        ])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for offset, frame in frames(memoryview(content.as_buffer())):
                    row = {"path": name, "offset": offset}
                    try:
                        if isinstance(frame, Damaged):
                            raise frame
                        row |= parsed(frame)
                    except Damaged as e:
                        row["error"] = str(e)
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(read, RECORD)


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """Rows for ``write_archives``: of pages with equal payloads of ``least`` bytes or more, the smallest page_id is
    the response and the others revisit it. Repeated rows of that smallest id are responses too; null ids come last."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1 and first is not null").select(F.col("payload_digest").alias("d"), "first")
    again = (F.col("first") != F.coalesce(F.col("page_id"), F.lit(-1) + F.col("first"))) & (F.col("payload_bytes") >= least)
    rows = rows.join(first, F.col("payload_digest") == F.col("d"), "left").withColumn("again", F.coalesce(again, F.lit(False)))
    return rows.select(
        "page_id", "url", F.when(F.col("again"), "revisit").otherwise("response").alias("kind"),
        F.when(F.col("again"), F.col("first")).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~F.col("again"), F.col("payload")).alias("payload"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page as a record, read the archives back and return their records. Pages without rows give none."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(page_records(pages), path)
    return read_archives(spark, path, payloads=False)
