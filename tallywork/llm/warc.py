"""WARC archives compressed with Zstandard: one frame per record, dictionary in the leading skippable frame.

Writing: every partition becomes one archive file. Tasks hand finished frames to Spark's text writer, so
files go through its commit protocol to any file system and a lost task is simply run again. The writer
wants a line separator; an empty skippable frame serves as one, which every Zstandard reader passes over.

Reading: an archive is one row of Spark's binaryFile source. The reader loads the dictionary from the
leading skippable frame, decodes frame by frame and validates every record: version line, mandatory
headers, declared lengths, block and payload digests. Frames need not state their content size. A damaged
record, or one that unpacks to more than 1 GB, becomes a row with its ``error`` and its neighbours are still read.

Records with equal payloads of at least ``least`` bytes are stored once: the one with the smallest page_id
as response, the others as revisit. Defined results: a null html is an empty payload; rows that repeat
the smallest page_id of their payload are all responses; a null page_id is larger than any other, and a
payload that only such rows hold is a response each time; a null url leaves the target out; an empty table
makes no archive and reads back as no rows; other columns of the table are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallywork.llm.common import take
from tallywork.session import shared_folder

# Magic numbers of Zstandard and of the format's dictionary frame; the layout of a record.
FRAME = 0xFD2FB528
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
SEPARATOR = "P*M\u0018\u0000\u0000\u0000\u0000"  # an empty skippable frame, 0x184D2A50
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PART, LARGEST = 1 << 20, 1 << 30  # bytes unpacked at a time, and of one record (a cell holds less than 2 GB)
FOUND = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
    "record_id string, payload binary, archive string, error string"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def encode(page_id, url, payload: bytes, digest: str, first, date: str) -> bytes:
    """The bytes of one record; ``first`` is the page that holds the payload when this one repeats it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d%s" % (len(payload), END)
    block = http if first is not None else http + payload
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c in "\r\n\t " else c for c in url)))
    if first is not None:
        headers += [("WARC-Refers-To", record_id(first)), ("WARC-Profile", REVISIT)]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = b"\r\n".join(f"{k}: {v}".encode() for k, v in headers)
    return VERSION + b"\r\n" + lines + END + block + END


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def split_headers(data: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, found, rest = data.partition(END)
    if not found:
        raise ValueError("headers do not end")
    first, *lines = head.split(b"\r\n")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError("header without a colon")
        headers[name.strip()] = value.strip()
    return first, headers, rest


def decode(data: bytes) -> dict:
    """The record in ``data``; raises ValueError with the first thing that is wrong."""
    version, headers, rest = split_headers(data)
    if version != VERSION:
        raise ValueError("unknown version")
    for name in MANDATORY:
        if name not in headers:
            raise ValueError(f"no {name}")
    length = int(headers["Content-Length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != END:
        raise ValueError("record length differs from Content-Length")
    if headers.get("WARC-Block-Digest", f"sha1:{sha1_base32(block)}") != f"sha1:{sha1_base32(block)}":
        raise ValueError("block digest differs")
    _, http, payload = split_headers(block)
    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    size, kind = int(http["Content-Length"]), headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("payload length or digest differs")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in headers):
        raise ValueError("revisit with a payload or without a reference")
    return {
        "page_id": page_of(headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": page_of(headers.get("WARC-Refers-To")), "url": headers.get("WARC-Target-URI"),
        "record_id": headers["WARC-Record-ID"], "payload": payload if kind == "response" else None, "error": None,
    }


def frame_end(data: bytes, start: int) -> int:
    """Where the compressed frame at ``start`` ends: its blocks are walked by their sizes."""
    at = start + 4
    flags = data[at]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    content = (single, 2, 4, 8)[flags >> 6]
    at += 1 + (not single) + (0, 1, 2, 4)[flags & 3] + content
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("archive ends inside a frame")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ValueError("archive ends inside a frame")
    return at


def inflate(reader: zstandard.ZstdDecompressor, frame: bytes, most: int) -> bytes:
    """The content of a frame, also of one that a streaming compressor wrote without its size; at most ``most`` bytes."""
    out, held = [], 0
    with reader.stream_reader(frame) as stream:
        while part := stream.read(PART):
            out.append(part)
            held += len(part)
            if held > most:
                raise ValueError(f"a frame holds more than {most} bytes")
    return b"".join(out)


def records(data: bytes, most: int = LARGEST):
    """Each record of an archive in turn, or a row that says what is wrong with it."""
    empty = dict.fromkeys(x.split()[0] for x in FOUND.split(", "))
    at, reader = 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        content = data[8 : 8 + size]
        if content[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be compressed
            content = inflate(zstandard.ZstdDecompressor(), content, most)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        at = 8 + size
    while at < len(data):
        try:
            magic, size = struct.unpack_from("<II", data + b"\0\0\0\0" if len(data) - at < 8 else data, at)
            if magic in SKIPPABLE:
                at += 8 + size
                continue
            if magic != FRAME:
                raise ValueError("no frame begins here")
            end = frame_end(data, at)
        except (ValueError, struct.error, IndexError) as e:  # without frame bounds the rest cannot be found
            yield empty | {"error": str(e)}
            return
        try:
            yield decode(inflate(reader, data[at:end], most))
        except (ValueError, KeyError, UnicodeDecodeError, zstandard.ZstdError) as e:
            yield empty | {"error": str(e) or type(e).__name__}
        at = end


def train_dictionary(pages: DataFrame, html: str = "html", sample: int = 500, size: int = 1 << 16) -> bytes:
    """A dictionary from at most ``sample`` pages and 16 KB of each; empty when they are too few to train."""
    rows = take(pages, html=html).where("html is not null")
    part = min(1.0, 2 * sample / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < part * 1_000_000)
    texts = [r["t"].encode() for r in chosen.select(F.substring("html", 1, 16_384).alias("t")).limit(sample).collect()]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_roles(pages: DataFrame, page_id="page_id", url="url", html="html", least: int = 0) -> DataFrame:
    """page_id, url, payload, its SHA-1, and ``first``: the page whose payload this one repeats, else null."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = take(pages, page_id=page_id, url=url, html=html).select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    long_enough = rows.where(F.octet_length("payload") >= least)
    groups = long_enough.groupBy("sha1").agg(F.min("page_id").alias("smallest"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select(F.col("sha1").alias("_sha1"), "smallest")
    joined = rows.join(groups, F.col("sha1") == F.col("_sha1"), "left")
    repeats = F.col("page_id").isNull() | (F.col("page_id") != F.col("smallest"))
    return joined.select("page_id", "url", "payload", "sha1", F.when(repeats, F.col("smallest")).alias("first"))


def write_archives(
    pages: DataFrame, path: str, page_id="page_id", url="url", html="html", least: int = 0,
    date: str = "2024-01-01T00:00:00Z", level: int = 3,
) -> None:
    """Write ``pages`` as archives below ``path``; one file per partition, none for an empty one."""
    dictionary = train_dictionary(pages, html)
    held = pages.sparkSession.sparkContext.broadcast(dictionary)

    def frames(batches):
        given = zstandard.ZstdCompressionDict(held.value) if held.value else None
        writer = zstandard.ZstdCompressor(level=level, dict_data=given, write_checksum=True)
        begun = False
        for frame in batches:
            out = []
            if not begun and held.value and len(frame):
                out, begun = [skippable(DICTIONARY_FRAME, held.value)], True
            for page, link, payload, sha1, first in frame[["page_id", "url", "payload", "sha1", "first"]].itertuples(index=False):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                page, first = (None if pd.isna(x) else int(x) for x in (page, first))
                out.append(writer.compress(encode(page, link, bytes(payload), digest, first, date)))
            yield pd.DataFrame({"frame": out})

    # ids as text: pandas would turn whole numbers beside nulls into floats
    roles = with_roles(pages, page_id, url, html, least)
    roles = roles.withColumns({c: F.col(c).cast("string") for c in ("page_id", "first")})
    made = roles.mapInPandas(frames, "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """One row per record of the archives below ``path``, with ``error`` where a record is damaged."""

    def read(batches):
        for frame in batches:
            for name, content in zip(frame["path"], frame["content"]):
                rows, held = [], 0
                for row in records(bytes(content)):
                    rows.append(row | {"archive": name})
                    held += len(row["payload"] or b"")
                    if held > 16 << 20:
                        yield pd.DataFrame(rows).astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows).astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(read, FOUND)


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write the archives to the shared folder and return what reading them back gives."""
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **names)
    return read_archives(pages.sparkSession, path)
