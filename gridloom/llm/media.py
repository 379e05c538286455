"""Media columns: signature sniffing, type correction, carving.

An Aho-Corasick automaton finds every magic byte sequence in a blob in one pass (bytes mapped to
Latin-1 characters). Each hit is only a suspicion: the format's validator walks the structure from
there (chunk lengths, checksums, markers, end marks) and gives the confirmed length, or rejects it.
The medium at offset 0 that spans the blob decides its type, whatever was declared; others that are
confirmed inside are embedded media and can be carved by offset and length.

Work is per row: no exchange, memory bounded by a batch of a few MB or one blob.

Defined results: a null blob has no items and a null type; an empty one, and one in which nothing
is confirmed, keeps the declared type; equal blobs give equal results; other columns go along; an
empty table gives no rows. A very long blob is read whole, alone in its batch; marks and chains of
blocks are followed once a blob, so text full of magic bytes takes time in proportion to its length
(crafted PNG, WAV and gzip data can still make each hit read on to where it breaks).
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, small_batches

PAD = 64


class Blob(bytes):
    """Bytes that remember where marks stand and where chains of blocks lead, so that many hits in one blob cost no more than one."""

    def places(self, mark: bytes) -> array:
        """Where ``mark`` occurs, found once."""
        held = self.__dict__.setdefault(mark, None)
        if held is None:
            held, at = array("q"), self.find(mark)
            while at >= 0:
                held.append(at)
                at = self.find(mark, at + 1)
            self.__dict__[mark] = held
        return held

    def after(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, or -1."""
        held = self.places(mark)
        k = bisect_left(held, at)
        return held[k] if k < len(held) else -1

    def chain(self, name: str, at: int, step) -> int:
        """Where ``step`` (from a place to a later one, or to ~ of the last) leads from ``at``; each place is walked once."""
        known = self.__dict__.setdefault(name, {})
        trail = []
        while at >= 0 and at not in known:
            trail.append(at)
            at = step(at)
        end = known[at] if at >= 0 else at
        for place in trail:
            known[place] = end
        return ~end


# --- validators: a blob and an offset to the confirmed (length, body offset, body length), or None
def _wav(b: bytes, at: int):
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, align, body = at + 12, 0, None
    while pos + 8 <= end <= len(b):
        name, size = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            align = struct.unpack_from("<H", b, pos + 20)[0]
        elif name == b"data":
            body = (pos + 8, size)
        pos += 8 + size + size % 2
    return (end - at, *body) if body and align and body[1] % align == 0 and pos >= end and end <= len(b) else None


def _webp(b: bytes, at: int):
    size = struct.unpack_from("<I", b, at + 4)[0] if len(b) >= at + 8 else 0
    if b[at + 8 : at + 12] != b"WEBP" or b[at + 12 : at + 15] != b"VP8" or size < 12 or at + 8 + size > len(b):
        return None
    return 8 + size, at + 12, size - 4


def _png(b: bytes, at: int):
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, pos)
        if first and (name != b"IHDR" or size != 13) or pos + 12 + size > len(b):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return None
        pos, first = pos + 12 + size, False
        if name == b"IEND":
            return pos - at, at + 8, pos - at - 8
    return None


def _blocks(b: Blob, pos: int) -> int:
    """The place after a GIF's sub-blocks, or past the end."""
    return b.chain("blocks", pos, lambda p: p + 1 + b[p] if p < len(b) and b[p] else ~(p + 1))


def _gif(b: Blob, at: int):
    if b[at : at + 6] not in (b"GIF87a", b"GIF89a") or len(b) < at + 14:
        return None

    def step(pos: int) -> int:
        kind = b[pos] if pos < len(b) else 0
        if kind == 0x21:
            return _blocks(b, pos + 2)
        if kind == 0x2C and pos + 10 <= len(b):
            flags = b[pos + 9]
            return _blocks(b, pos + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
        return ~pos

    flags = b[at + 10]
    pos = b.chain("gif", at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), step)
    return (pos + 1 - at, at + 13, pos - at - 13) if pos < len(b) and b[pos] == 0x3B else None


def _jpeg(b: Blob, at: int):
    pos, scan = at + 2, False
    while pos + 4 <= len(b) and b[pos] == 0xFF and not scan:
        kind, size = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if kind == 0xFF:
            pos += 1
            continue
        if size < 2 or not 0xC0 <= kind <= 0xFE:
            return None
        pos, scan = pos + 2 + size, kind == 0xDA
    end = b.after(b"\xff\xd9", pos) if scan else -1
    return (end + 2 - at, at + 2, end - at - 2) if end >= 0 else None


def _bmp(b: bytes, at: int):
    if len(b) < at + 54:
        return None
    size, zero, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (width * bits + 31) // 32 * 4
    sound = zero == 0 and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and start >= 14 + head and size == start + row * abs(height)
    return (size, at + start, size - start) if sound and at + size <= len(b) else None


def _pdf(b: bytes, at: int):
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    end, table = b.after(b"%%EOF", at), b.after(b"startxref", at)
    return (end + 5 - at, at + 8, end - at - 8) if 0 <= table < end else None


def _gzip(b: bytes, at: int):
    z = zlib.decompressobj(31)
    try:
        pos = at
        while pos < len(b) and not z.eof:
            z.decompress(b[pos : pos + 65536])
            pos += 65536
    except zlib.error:
        return None
    length = min(pos, len(b)) - len(z.unused_data) - at
    return (length, at + 10, length - 18) if z.eof else None


def _zip(b: Blob, at: int):
    end = b.after(b"PK\5\6", at)
    if end < 0 or len(b) < end + 22:
        return None
    entries, size, start, note = struct.unpack_from("<HIIH", b, end + 10)
    sound = entries and at + start + size == end and b[at + start : at + start + 4] == b"PK\1\2" and end + 22 + note <= len(b)
    return (end + 22 + note - at, at, start) if sound else None


def _mp4(b: Blob, at: int):
    """Boxes from ``ftyp`` (whose length stands before it) on; ``moov`` must be among them."""
    first = at - 4
    if first < 0 or not 16 <= int.from_bytes(b[first:at], "big") <= 4096:
        return None

    def step(pos: int) -> int:
        size, name = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        return pos + size if name in BOXES and size >= 8 and pos + size <= len(b) else ~pos

    end = b.chain("mp4", first, step)
    film = b.after(b"moov", first)
    return (end - first, first, end - first) if first < film < end else None


BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"sidx", b"styp", b"udta", b"uuid", b"meta")
#: Magic bytes, media type and validator of each format.
FORMATS = (
    (b"RIFF", "audio/wav", _wav),
    (b"RIFF", "image/webp", _webp),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF8", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\3\4", "application/zip", _zip),
    (b"ftyp", "video/mp4", _mp4),
)


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in dict.fromkeys(m for m, _, _ in FORMATS):
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(blob: bytes) -> list[tuple[int, int, str, int, int]]:
    """The confirmed media in a blob: (offset, length, type, body offset, body length), by offset."""
    blob, items = Blob(blob), []
    for end, magic in _automaton().iter(blob.decode("latin-1")):
        at = end + 1 - len(magic)
        for own, kind, validate in FORMATS:
            if own == magic and (hit := validate(blob, at)):
                at = hit[1] if kind == "video/mp4" else at  # its length stands before the mark
                items.append((at, hit[0], kind, hit[1], hit[2]))
    return sorted(items)


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Bytes as unsigned 8-bit mono samples."""
    odd = len(samples) % 2
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples) + odd, b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * odd


def _as_wav(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in small_batches(whole, "_payload"):
            media = pa.array([wav(x) for x in batch.column("_payload").to_pylist()], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("_payload"), "media", media)


def texts_to_wav(df: DataFrame, text: str = "text") -> DataFrame:
    """(..., n_bytes, declared, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as 8-bit samples."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = F.octet_length("_raw")
    fill = F.when(size == 0, PAD).otherwise((PAD - size % PAD) % PAD)
    zeros = F.unhex(F.lit("00" * PAD))
    rows = df.drop("n_bytes", "declared", "media", "_raw", "_payload").withColumn("_raw", raw)
    rows = rows.select(*[c for c in rows.columns if c not in (text, "_raw")], size.cast("long").alias("n_bytes"), F.lit("application/octet-stream").alias("declared"), F.concat("_raw", F.substring(zeros, F.lit(1), fill)).alias("_payload"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1]) + ", media binary"
    return rows.mapInArrow(_as_wav, schema)


ITEM = "array<struct<offset:long,length:long,type:string,body_offset:long,body_length:long>>"


def _sniff(blobs: pd.Series) -> pd.Series:
    names = ("offset", "length", "type", "body_offset", "body_length")
    return pd.Series([None if x is None else [dict(zip(names, i, strict=True)) for i in sniff(x)] for x in blobs], dtype=object)


def media_types(df: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """Adds ``items`` (the confirmed media), ``media_type`` (the type found, else the declared one) and ``corrected``."""
    rows = df.drop("items", "media_type", "corrected").withColumn("items", F.pandas_udf(_sniff, ITEM)(media))
    whole = F.get(F.filter("items", lambda i: (i["offset"] == 0) & (i["length"] == F.octet_length(media))), F.lit(0))
    kind = F.when(F.col(media).isNotNull(), F.coalesce(whole["type"], F.col(declared)))
    return rows.withColumn("media_type", kind).withColumn("corrected", F.coalesce(F.col("media_type") != F.col(declared), F.lit(False)))


def carve(df: DataFrame, media: str = "media", body: bool = False) -> DataFrame:
    """A row for each confirmed medium of ``media_types``' rows: ``item`` and its bytes ``carved`` (of ``body``, the samples or chunks alone)."""
    rows = df.drop("item", "carved").withColumn("item", F.explode("items"))
    at, size = (F.col("item.body_offset"), F.col("item.body_length")) if body else (F.col("item.offset"), F.col("item.length"))
    return rows.withColumn("carved", F.substring(F.col(media), (at + 1).cast("int"), size.cast("int")))


def op2_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(texts_to_wav(read(spark, sf_dir, "documents").select("doc_id", "text")))
    found = carve(media_types(stored), body=True).where("item.offset = 0 AND item.type = media_type")
    tail = F.substring(F.col("carved"), (F.octet_length("carved") - PAD + 1).cast("int"), F.lit(PAD))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("carved").cast("long").alias("payload_bytes"),
        F.sha2("carved", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "media_type", F.concat(F.lit("items="), F.size("items")), F.concat(F.lit("body="), F.col("item.body_offset"), F.lit("+"), F.col("item.body_length"))).alias("feature"),
        "corrected",
    )


#: The same from hexadecimal text: sizes, header, samples and the checksum of the last 64 bytes, bit by bit. Texts hold no media here.
ORACLE_SQL = """
WITH table_ AS (SELECT list(list_reduce(range(9), lambda a, x: CASE WHEN x = 0 THEN a WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS n, raw || unhex(repeat('00', CAST(CASE WHEN octet_length(raw) = 0 THEN 64 ELSE (64 - octet_length(raw) % 64) % 64 END AS BIGINT))) AS payload FROM d),
q AS (SELECT *, CAST(octet_length(payload) AS BIGINT) AS m FROM p),
f AS (SELECT *, unhex('52494646' || {size('m + 36')} || '57415645' || '666D7420' || '10000000' || '01000100' || '401F0000' || '401F0000' || '01000800' || '64617461' || {size('m')}) || payload AS media FROM q)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(payload) AS payload_sha256,
    CAST(xor(list_reduce(list_transform(range(64), lambda i: CAST('0x' || substr(right(hex(payload), 128), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1]), 4294967295), 4294967295) AS BIGINT) AS tail_crc32,
    CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256, 'audio/wav;items=1;body=44+' || m AS feature, true AS corrected
FROM f, table_
"""
_LITTLE = "printf('%02X%02X%02X%02X', ({0}) % 256, ({0}) // 256 % 256, ({0}) // 65536 % 256, ({0}) // 16777216)"
for _size in ("m + 36", "m"):
    ORACLE_SQL = ORACLE_SQL.replace("{size('" + _size + "')}", _LITTLE.format(_size))
