"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a binary value; a validator
for each format confirms the structure and gives the length; what is confirmed corrects the declared type and
is carved out. Matches inside a confirmed medium are passed over.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import table


def png_length(b: bytes, at: int) -> int:
    """Length of the PNG at `at`, 0 if a chunk or its checksum is wrong or IEND is missing."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack(">I4s", b[p : p + 8])
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack(">I", b[p + 8 + n : p + 12 + n])[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def riff_length(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    n = 8 + struct.unpack("<I", b[at + 4 : at + 8])[0]
    if n < 12 or at + n > len(b):
        return 0
    p = at + 12
    while p + 8 <= at + n:
        size = struct.unpack("<I", b[p + 4 : p + 8])[0]
        p += 8 + size + (size & 1)
    return n if p == at + n else 0


def gif_length(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0)
        elif kind == 0x21:
            p += 2
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def jpeg_length(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        p += 2 + struct.unpack(">H", b[p + 2 : p + 4])[0]
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return 0
    return p + 2 - at if b[p : p + 2] == b"\xff\xd9" else 0


def bmp_length(b: bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    n, zero, data, head = struct.unpack("<IIII", b[at + 2 : at + 18])
    return n if not zero and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= data <= n <= len(b) - at else 0


def pdf_length(b: bytes, at: int) -> int:
    """Up to the last %%EOF before another PDF whose startxref points, from at, to a cross-reference; if there is none, the
    other PDF is inside this one, and the last such %%EOF after it counts; else the last %%EOF before the other."""
    other = b.find(b"%PDF-", at + 5)
    other, valid, inside, near = len(b) if other < 0 else other, 0, 0, 0
    for m in re.compile(rb"startxref\s+(\d{1,18})\s+%%EOF").finditer(b, at):
        if re.compile(rb"xref\b|\d+\s+\d+\s+obj\b").match(b, min(m.end(), at + int(m[1])), m.end()):
            valid, inside = (m.end() - at, inside) if m.end() <= other else (valid, m.end() - at)
        if m.end() <= other:
            near = m.end() - at
    if valid or inside or near:
        return valid or inside or near
    end = b.find(b"%%EOF", at)
    return end + 5 - at if end >= 0 and b.find(b"startxref", at, end) >= 0 else 0


def zip_length(b: bytes, at: int) -> int:
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, offset, note = struct.unpack("<IIH", b[end + 12 : end + 22])
    return end + 22 + note - at if at + offset + size == end and end + 22 + note <= len(b) else 0


FORMATS = {
    b"\x89PNG\r\n\x1a\n": ("image/png", png_length), b"RIFF": ("audio/wav", riff_length), b"GIF87a": ("image/gif", gif_length), b"GIF89a": ("image/gif", gif_length),
    b"\xff\xd8\xff": ("image/jpeg", jpeg_length), b"BM": ("image/bmp", bmp_length), b"%PDF-": ("application/pdf", pdf_length), b"PK\x03\x04": ("application/zip", zip_length),
}
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in FORMATS:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def sniff(value: bytes, machine) -> list[tuple[int, int, str]]:
    """Offset, length and type of the confirmed media in value, leftmost first, none inside another."""
    out, free = [], 0
    for end, magic in machine.iter(value.decode("latin-1")):
        at = end + 1 - len(magic)
        kind, length = FORMATS[magic]
        if at >= free and (n := length(value, at)):
            out.append((at, n, RIFF_KINDS[value[at + 8 : at + 12]] if magic == b"RIFF" else kind))
            free = at + n
    return out


def sniff_media(frame: DataFrame, key: str, content: str, declared: str | None = None) -> DataFrame:
    """One row for each confirmed medium: key, offset, length, media_type, whole (it is the entire value), declared_type
    and mismatch, media (the carved bytes).

    Defined results: null or empty values and values without a medium give no row; repeated rows each give
    theirs; nulls in key or declared type are carried, and a null declared type is a mismatch; very long values are
    searched whole; an empty table gives no rows; other columns are ignored, so that their names can't clash."""
    from pyspark.sql import functions as F

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        machine = automaton()
        for b in batches:
            out = [(k, at, n, kind, n == len(v), d, d != kind, bytes(v[at : at + n])) for k, v, d in zip(b["k"], b["v"], b["d"]) if v for at, n, kind in sniff(bytes(v), machine)]
            yield pd.DataFrame(out, columns=["k", "offset", "length", "media_type", "whole", "declared_type", "mismatch", "media"])

    if key in ("offset", "length", "media_type", "whole", "declared_type", "mismatch", "media"):
        raise ValueError(f"the key column {key} has the name of a result column")
    cols = frame.select(F.col(key).cast("string").alias("k"), F.col(content).alias("v"), (F.col(declared) if declared else F.lit(None)).cast("string").alias("d"))
    return cols.mapInPandas(run, "k string, offset long, length long, media_type string, whole boolean, declared_type string, mismatch boolean, media binary").withColumnRenamed("k", key)


UNIT = 576


def store(payload: bytes) -> bytes:
    """The payload as an 8-bit grey PNG, UNIT samples wide."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = len(payload) // UNIT
    lines = b"".join(b"\0" + payload[i * UNIT : (i + 1) * UNIT] for i in range(rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def samples(png: bytes) -> bytes:
    """The 8-bit samples of a grey PNG whose lines are unfiltered."""
    width = struct.unpack(">I", png[16:20])[0]
    p, data = 8, []
    while p < len(png):
        n, kind = struct.unpack(">I4s", png[p : p + 8])
        if kind == b"IDAT":
            data.append(png[p + 8 : p + 8 + n])
        p += 12 + n
    lines = zlib.decompress(b"".join(data))
    return b"".join(lines[i + 1 : i + 1 + width] for i in range(0, len(lines), width + 1))


#: What stands before and after the stored form in op1's containers, which are declared as DECLARED.
DECLARED, BEFORE, AFTER = "text/plain", b"\0container BM RIFF \x89PNG\0", b"\0IEND trailer"


def op1_media(spark, sf_dir: str) -> DataFrame:
    """Each text is stored as a PNG inside a container that is declared as plain text, with other bytes (false magics among
    them) before and after. The sniffer finds the medium, corrects the declared type and carves it; the payload is read back
    from what was carved. media_offset, declared_type, found_type, mismatch: what the sniffer says of the container; feature:
    the type, width x height, the mean sample and the confirmed length.

    Defined results: a null or empty text is one unit of bytes 255; repeated rows and null ids each give a row; an empty table
    gives none; further columns are ignored."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        machine = automaton()
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                container = BEFORE + store(raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT)) + AFTER
                (at, n, kind), *_ = sniff(container, machine)
                media = container[at : at + n]
                back = samples(media)
                feature = f"{kind};{UNIT}x{len(back) // UNIT};mean={np.frombuffer(back, np.uint8).mean():.6f};length={n}"
                found = at, DECLARED, kind, kind != DECLARED
                out.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, *found))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_offset long, declared_type string, found_type string, mismatch boolean"
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, schema)
