"""Zstandard WARC archives: a dictionary in the leading skippable frame, one frame per record, checked on reading."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from nodewell.llm.common import materialise

#: Magic of the skippable frame that holds the dictionary, and of a Zstandard frame (fixed values of the formats).
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
#: An archive is closed at so many records or bytes of records.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 1000, 16 << 20
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 512 << 10


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(number: int | None, payload_digest: str) -> str:
    """A URN for a row's number (64 bits, any sign); rows without one get an id of their payload, marked by version 0."""
    if number is None:
        low = hashlib.sha1(payload_digest.encode()).hexdigest()[:16]
        return f"<urn:uuid:00000000-0000-0000-{low[:4]}-{low[4:]}>"
    low = f"{number & (2**64 - 1):016x}"
    return f"<urn:uuid:00000000-0000-8000-{low[:4]}-{low[4:]}>"


def number_of(urn: str | None) -> int | None:
    """The row's number in a record id of ours, else null."""
    m = re.fullmatch(r"<urn:uuid:00000000-0000-8000-([0-9a-f]{4})-([0-9a-f]{12})>", urn or "")
    return struct.unpack(">q", bytes.fromhex(m[1] + m[2]))[0] if m else None


def write_record(url: str | None, payload: bytes, own: str, refers_to: str | None, date: str) -> bytes:
    """A response record with the payload, or a revisit record with its HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", own),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to:
        head += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", refers_to)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + CRLF + block + CRLF + CRLF


def _headers(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    for x in lines:
        name, colon, value = x.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {x[:60]!r}")
        if name.lower() in found:
            raise WarcError(f"header {name} twice")
        found[name.lower()] = value.strip()
    return found


def read_record(raw: bytes) -> dict:
    """The fields of one record, after its version, headers, lengths and digests have been checked."""
    head, gap, rest = raw.partition(CRLF + CRLF)
    version, *lines = head.split(CRLF)
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise WarcError(f"no WARC record: {raw[:40]!r}")
    h = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise WarcError(f"{name} is missing")
    if not h["content-length"].isdigit():
        raise WarcError("content-length is no number")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != CRLF + CRLF:
        raise WarcError(f"the block has {len(rest) - 4} bytes, content-length says {n}")
    block = rest[:n]
    if h.get("warc-block-digest", "sha1:").removeprefix("sha1:") not in ("", digest(block)):
        raise WarcError("the block's digest differs")
    out = {"type": h["warc-type"], "record_id": h["warc-record-id"], "refers_to": h.get("warc-refers-to"), "uri": h.get("warc-target-uri"), "date": h["warc-date"]}
    payload, size, payload_digest = block, n, h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if h.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(CRLF + CRLF)
        status, *lines = http.split(CRLF)
        if not gap or not status.startswith(b"HTTP/"):
            raise WarcError("no HTTP head")
        size = int(_headers(lines).get("content-length", len(payload)))
    if out["type"] == "revisit":
        if payload or not out["refers_to"]:
            raise WarcError("a revisit has a reference and no payload")
    elif len(payload) != size:
        raise WarcError(f"the payload has {len(payload)} bytes, its head says {size}")
    elif payload_digest and payload_digest != digest(payload):
        raise WarcError("the payload's digest differs")
    return out | {"payload_bytes": size, "payload_digest": payload_digest or digest(payload), "payload": None if out["type"] == "revisit" else payload}


def write_archive(records: list[bytes]) -> bytes:
    """A dictionary fitted on these records in a skippable frame, then one frame per record."""
    samples, size = [], 0
    for r in records[:: max(1, len(records) // 128)]:
        samples.append(r[: SAMPLE_BYTES // 64])
        size += len(samples[-1])
    dictionary = None
    if len(samples) >= 16 and size >= 8 * DICTIONARY_BYTES // 2:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:
            dictionary = None  # too little in common: the archive has none
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
    frames = [compressor.compress(r) for r in records]
    if dictionary is not None:
        raw = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
        frames.insert(0, struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    return b"".join(frames)


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time. The dictionary may itself be compressed."""
    dictionary, at = None, 0
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_MAGIC:
        n = struct.unpack_from("<I", content, 4)[0]
        if len(content) < 8 + n:
            raise WarcError("the dictionary's frame is cut off")
        raw, at = content[8 : 8 + n], 8 + n
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader, view = zstandard.ZstdDecompressor(dict_data=dictionary), memoryview(content)
    while at < len(content):
        magic = struct.unpack_from("<I", content, at)[0] if len(content) - at >= 8 else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one = reader.decompressobj()
        # Frames are fed in growing slices, so that a frame costs its own length and not the rest of the archive's.
        parts, step, start = [], 1 << 16, at
        while not one.eof:
            if start >= len(content):
                raise WarcError(f"the frame at byte {at} is cut off")
            piece = view[start : start + step]
            parts.append(one.decompress(piece))
            start += len(piece)
            step = min(2 * step, 1 << 24)
        at = start - len(one.unused_data)
        yield b"".join(parts)


def write_archives(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(content) : archives of some MB, one record per row of df, written to the shared folder.

    Of rows with equal payloads of min_revisit_bytes or more, the one with the smallest key is a response and others
    refer to it. Null html is an empty payload, a null url about:blank. A null key is never referred to; a record
    refers to another key only, so repeated rows with the smallest key are all responses. The smallest keys are
    aggregated over digests alone; the pages then go to tasks by digest, where Spark splits digests that many have.
    """
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(url).alias("u"), F.coalesce(F.col(html), F.lit("")).alias("p"))
    rows = rows.withColumn("s", F.sha1(F.col("p").cast("binary")))
    least = rows.where(F.octet_length("p") >= min_revisit_bytes).groupBy("s").agg(F.min("k").alias("first"), F.count("*").alias("c")).where("c > 1").select("s", "first")
    named = materialise(least, "repeated-payloads")
    small = named.count() <= 500_000
    joined = rows.join(F.broadcast(named) if small else named, "s", "left").select("k", "u", F.col("p").cast("binary"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        size = 0
        for b in batches:
            for i in range(b.num_rows):
                k, u, p, first = (c[i].as_py() for c in b.columns)
                payload = bytes(p)
                own = record_id(k, f"{digest(payload)}{u}")
                refers = record_id(first, "") if first is not None and first != k else None
                records.append(write_record(u, payload, own, refers, date))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES or len(records) >= ARCHIVE_RECORDS:
                    yield pa.RecordBatch.from_arrays([pa.array([write_archive(records)], pa.binary())], ["content"])
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([write_archive(records)], pa.binary())], ["content"])

    return materialise(joined.mapInArrow(run, "content binary"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of archives in a column content, such as spark.read.format("binaryFile") gives: type, record_id,
    refers_to, uri, date, payload_bytes, payload_digest and payload (null for revisits). A null content has no records;
    an archive that breaks the format raises WarcError."""
    names = ["type", "record_id", "refers_to", "uri", "date", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0):
                rows: list[dict] = []
                size = 0
                for raw in read_archive(c.as_py() or b""):
                    rows.append(read_record(raw))
                    size += len(raw)
                    if size >= ARCHIVE_BYTES:
                        yield _record_rows(rows, names, kinds)
                        rows, size = [], 0
                yield _record_rows(rows, names, kinds)

    schema = "type string, record_id string, refers_to string, uri string, date string, payload_bytes bigint, payload_digest string" + ", payload binary" * with_payload
    return archives.select("content").mapInArrow(run, schema)


def _record_rows(rows: list[dict], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)
