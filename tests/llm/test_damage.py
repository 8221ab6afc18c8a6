"""Readers of foreign bytes: damaged inputs give rows or errors, never exceptions."""

import random
import struct

import zstandard

from assaylake.llm import media, warc


def damaged(rng, good: bytes, most: int = 3, reach: int | None = None) -> bytes:
    out = bytearray(good)
    for _ in range(rng.randint(1, most)):
        at = rng.randrange(min(reach or len(out), len(out)))
        match rng.randrange(3):
            case 0:
                out[at] = rng.randrange(256)
            case 1:
                del out[at : at + rng.randint(1, 9)]
            case _:
                out[at:at] = rng.randbytes(rng.randint(1, 9))
        if not out:
            break
    return bytes(out[: rng.randrange(len(out) + 1)]) if rng.random() < 0.2 else bytes(out)


def test_damaged_archives():
    """4,000 archives with changed, cut or inserted bytes, near the start and anywhere."""
    rng = random.Random(11)
    records = [warc.record(i, f"http://a/{i}", b"<p>text %d</p>" % i * 20, warc.digest(b"<p>text %d</p>" % i * 20), None, 20 * len(b"<p>text %d</p>" % i)) for i in range(40)]
    good = warc.pack(records)
    assert struct.unpack_from("<I", good)[0] == warc.DICT_FRAME and sum(e is None for _, e in warc.frames(good)) == 40
    for k in range(4000):
        rows = [warc.parse(f) if e is None else {"error": e} for f, e in warc.frames(damaged(rng, good, reach=600 if k % 2 else None))]
        assert all(r["error"] is None or isinstance(r["error"], str) for r in rows)


def test_damaged_records():
    rng = random.Random(12)
    good = warc.record(7, "http://a/b", b"abc", warc.digest(b"abc"), 5, 3)
    for _ in range(3000):
        out = warc.parse(damaged(rng, good))
        assert all(out[n] is None or -(2**63) <= out[n] < 2**63 for n in ("page_id", "refers_to", "payload_bytes"))


def test_odd_numbers_and_dictionaries():
    good = warc.record(7, None, b"abc", warc.digest(b"abc"), None, 3)
    length = b"Content-Length: %d\r\n\r\nHTTP" % (len(warc.HTTP % 3) + 3)
    assert length in good and warc.parse(good)["error"] is None
    for odd in ("²", "-1", "9" * 30, "", "1 "):
        assert warc.parse(good.replace(length, f"Content-Length: {odd}\r\n\r\nHTTP".encode()))["error"] == "wrong Content-Length or ending"
    for odd in (b"<urn:page:--5>", b"<urn:page:9999999999999999999>", b"<urn:page:5", "<urn:page:²>".encode()):
        assert warc.parse(good.replace(b"<urn:page:7>", odd))["page_id"] is None
    revisit = warc.record(8, None, b"", warc.digest(b"abc"), 7, 3)
    for odd in (b"9" * 30, "²".encode(), b"-4"):
        assert warc.parse(revisit.replace(b"Payload-Length: 3", b"Payload-Length: " + odd))["payload_bytes"] is None
    frame = zstandard.ZstdCompressor().compress(b"x" * 100)
    for body in (warc.DICT_MAGIC + b"\0" * 40, b"", frame[:-3], warc.FRAME_MAGIC + b"\xff" * 9, frame):
        assert list(warc.frames(struct.pack("<II", warc.DICT_FRAME, len(body)) + body + frame)) == [(b"", "bad dictionary")]


def test_damaged_media():
    """4,000 streams with changed, cut or inserted bytes; and the headers that end too early."""
    rng = random.Random(13)
    good = media.write_stream(rng.randbytes(3000))
    assert len(media.read_stream(good).payload) == 3000
    for k in range(4000):
        s = media.read_stream(damaged(rng, good, reach=300 if k % 2 else None))
        assert s.duration >= 0 and isinstance(s.feature(), str)
    for n in range(20):
        media.read_stream(b"ID3\x04\0\x40" + bytes(n))
        media.read_stream(b"ID3\x03\0\x40" + bytes(4) + bytes(n))
    for head in (b"\xff\xfb\x10\x44", b"\xff\xf3\x10\xc4", b"\xff\xfa\x90\xc0"):
        for n in range(26, 80):
            frame = (head + b"\0" * 32 + b"VBRI").ljust(n, b"\0")
            media.read_stream(frame + head * 3)
    assert media.read_stream(good.replace(b"payload\x003000", b"payload\x003\xc2\xb20")).headers
