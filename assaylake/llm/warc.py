"""WARC archives in Zstandard frames: one frame a record, with the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table, tune

#: Decompressed bytes of one record at most; a larger one is reported and skipped.
MOST = 1 << 30
#: Digest algorithms that are compared; others are left alone.
ALGORITHMS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512, "md5": hashlib.md5}
#: Fixed by the formats: the skippable frame that holds a dictionary, the magic numbers of dictionaries and frames.
DICT_FRAME, DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
REQUIRED = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length")
DATE = "2026-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(x: str) -> bytes:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in x).encode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, n_bytes: int) -> bytes:
    """One record. A revisit has no payload; its Payload-Length and digest are those of the full one."""
    revisit = refers_to is not None
    block = HTTP % n_bytes + (b"" if revisit else payload)
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Date: " + DATE.encode()]
    lines.append(b"WARC-Record-ID: <urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id))
    if url:
        lines.append(b"WARC-Target-URI: " + _one_line(url))
    if revisit:
        lines += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [b"WARC-Payload-Digest: sha1:" + sha1.encode(), b"Payload-Length: %d" % n_bytes, b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes], dict_bytes: int = 16384) -> bytes:
    """An archive: the dictionary, trained on a bounded sample of its first records, then a frame a record."""
    sample, out, compressor = [r[:8192] for r in records[:128]], [], None
    if len(sample) >= 16:
        try:
            trained = zstandard.train_dictionary(dict_bytes, sample, level=3)
            out.append(struct.pack("<II", DICT_FRAME, len(trained.as_bytes())) + trained.as_bytes())
            compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        except zstandard.ZstdError:  # too few or too uniform samples: an archive without dictionary
            out.clear()
    compressor = compressor or zstandard.ZstdCompressor(level=3, write_checksum=True)
    return b"".join(out + [compressor.compress(r) for r in records])


@lru_cache(maxsize=2)
def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def _dictionary(body: bytes) -> bytes:
    """The dictionary in a skippable frame's body, which may be compressed itself; empty where it is none."""
    try:
        found = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 26) if body[:4] == FRAME_MAGIC else body
        if found[:4] != DICT_MAGIC:
            return b""
        _decompressor(found).decompressobj()
    except zstandard.ZstdError:
        return b""
    return found


def frames(archive: bytes, most: int = MOST) -> Iterator[tuple[bytes, str | None]]:
    """(content, error) of every frame after the dictionary; a frame of over ``most`` bytes gives an error only. A damaged frame gives its error and ends the archive, as the next one's start is not known."""
    at, dictionary, view = 0, b"", memoryview(archive)
    while at < len(archive):
        if len(archive) - at >= 8 and struct.unpack_from("<I", archive, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            magic, n = struct.unpack_from("<II", archive, at)
            body = bytes(view[at + 8 : at + 8 + n])
            if len(body) < n:
                yield b"", "cut skippable frame"
                return
            if at == 0 and magic == DICT_FRAME:
                dictionary = _dictionary(body)
                if not dictionary:
                    yield b"", "bad dictionary"
                    return
            at += 8 + n
            continue
        reader, parts, size, total = _decompressor(dictionary).decompressobj(), [], 1 << 12, 0
        try:
            while not reader.eof and at < len(archive):
                fed = view[at : at + size]
                parts.append(reader.decompress(fed))
                at += len(fed)
                total += len(parts[-1])
                if total > most:
                    parts.clear()
        except zstandard.ZstdError as e:
            yield b"", f"bad frame: {e}"
            return
        if not reader.eof:
            yield b"", "cut frame"
            return
        at -= len(reader.unused_data)
        yield (b"".join(parts), None) if total <= most else (b"", f"record of {total} bytes")


def _number(text: str | None) -> int | None:
    """A length or an id in ASCII digits that fits in 64 bits; else None."""
    found = int(text) if text and re.fullmatch("-?[0-9]{1,19}", text) else None
    return found if found is not None and -(2**63) <= found < 2**63 else None


def _page(uri: str | None) -> int | None:
    return _number(uri[10:-1]) if uri and uri.startswith("<urn:page:") and uri.endswith(">") else None


def _fields(lines: list[bytes]) -> dict[str, str] | None:
    """Named fields by lower-case name, folded lines joined; None where a line is no field. Of a repeated field the first counts."""
    joined: list[bytes] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and joined:
            joined[-1] += b" " + line.strip()
        else:
            joined.append(line)
    out: dict[str, str] = {}
    for line in joined:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None
        out.setdefault(name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip())
    return out


def _agrees(stated: str | None, data: bytes) -> bool:
    """Whether a labelled digest in base 32 or 16 is that of the data; one of an unknown algorithm is not compared."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() not in ALGORITHMS or not value:
        return True
    made = ALGORITHMS[kind.lower()](data)
    return value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=") or value.lower() == made.hexdigest()


def parse(content: bytes) -> dict:
    """One frame's record, validated: version, header lines, required fields, lengths, ending, digests.

    The payload is the HTTP body of records whose block is an HTTP message, and the whole block of all others. A revisit
    without the length of what it refers to has null payload_bytes.
    """
    out = dict.fromkeys(("record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "error"))
    head, split, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = _fields(lines[1:])
    if fields is None:
        return out | {"error": "bad header line"}
    out |= {"record_id": fields.get("warc-record-id"), "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "refers_to": _page(fields.get("warc-refers-to"))}
    if not split or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        return out | {"error": "bad version or no end of headers"}
    if missing := [n for n in REQUIRED if n.lower() not in fields]:
        return out | {"error": f"missing {missing[0]}"}
    if (length := _number(fields["content-length"])) is None or len(rest) != length + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "wrong Content-Length or ending"}
    block = rest[:-4]
    if not _agrees(fields.get("warc-block-digest"), block):
        return out | {"error": "wrong block digest"}
    http = fields.get("content-type", "").lower().replace(" ", "").startswith("application/http") and out["record_type"] in ("response", "request", "revisit")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    stated = fields.get("warc-payload-digest")
    if out["record_type"] == "revisit":
        length = _number(fields.get("payload-length"))
        kind, _, value = (stated or "").partition(":")
        return out | {"payload_bytes": length if length is not None and length >= 0 else None, "payload_digest": value if kind.lower() == "sha1" else None, "payload": b""}
    if not _agrees(stated, payload):
        return out | {"error": "wrong payload digest"}
    return out | {"payload_bytes": len(payload), "payload_digest": digest(payload), "payload": payload}


def _write(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row["page_id"], row["url"], row["payload"] or b"", base64.b32encode(row["sha1"]).decode(), row["refers_to"], row["n_bytes"]))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"content": pa.array([pack(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"content": pa.array([pack(held)], pa.binary())})

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 1 << 20) -> DataFrame:
    """pages (page_id, url, html) -> archives (content binary), each of about ``archive_bytes`` before compression.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page_id is a response and the others
    are revisits of it (rows that repeat that page_id too: they stay responses). A null html is an empty payload; a
    record whose page_id is null is always a response. An empty table gives no archive.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    firsts = saved(rows.filter(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("sha1", "first"))
    slim = rows.select("page_id", "sha1", "n_bytes")
    revisits = slim.filter(F.col("n_bytes") >= min_bytes).join(firsts, "sha1").filter("page_id > first").select("page_id", "sha1", F.col("first").alias("refers_to")).distinct()
    marked = rows.join(revisits, ["page_id", "sha1"], "left")
    return marked.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).mapInArrow(_write(archive_bytes), "content binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
    for batch in batches:
        for content in batch.column(0).to_pylist():
            held, size = [], 0
            for frame, error in frames(content or b""):
                held.append(parse(frame) if error is None else {"error": error})
                size += len(frame)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of archives given as rows with a ``content`` binary: write_archives()' output, or .warc.zst files by spark.read.format("binaryFile").

    Every record is validated; one that fails has its reason in ``error`` (null otherwise) and whatever fields could be
    read. A page_id is read from record ids of the form that write_archives() gives; any other id is in record_id only.
    A damaged or cut
    dictionary, frame or record gives a row with its error, never an exception. A null or empty content has no record.
    """
    return tune(archives.sparkSession) and archives.select("content").mapInArrow(_read, RECORD)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives, which are saved when it is called, and read back from them."""
    archives = saved(write_archives(table(spark, sf_dir, "pages")), "none")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first FROM payloads GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1) FOR i IN range(0, 32)], '') AS payload_digest
FROM payloads JOIN firsts USING (h)
"""
