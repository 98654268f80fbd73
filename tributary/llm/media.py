"""Media columns: signature sniffing.

One Aho-Corasick automaton over the magic bytes of the known formats finds every place where a medium may start. A validator of
the format then confirms its structure and gives its length, so stray magic bytes in other data are no media. A medium at place 0 that
covers the whole column corrects the declared type; media further inside are carved out. FLAC states no length: such a medium ends with the data.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column

BLOCK = 64
RATE = 8000
#: What stands before a stored file, and the type that is declared for both.
CARRIER = b"CARRIER\x00"
DECLARED = "image/png"


class Data(bytes):
    """Bytes that find each end mark once: many starts that look for the same mark cost one search of the whole."""

    def after(self, mark: bytes, at: int) -> int:
        """First place of mark from `at` on, or -1."""
        known = self.__dict__.setdefault(mark, [])
        if not known:
            x = self.find(mark)
            while x >= 0:
                known.append(x)
                x = self.find(mark, x + 1)
            known.append(len(self))
        k = known[bisect.bisect_left(known, at)] if at < len(self) else len(self)
        return k if k < len(self) else -1


def wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono PCM."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def _riff(b: Data, at: int) -> tuple[str, int] | None:
    if len(b) < at + 12:
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    end, form = at + size, b[at + 8 : at + 12]
    if size < 12 or end > len(b):
        return None
    x, seen = at + 12, set()
    while x + 8 <= end:
        seen.add(b[x : x + 4])
        n = struct.unpack_from("<I", b, x + 4)[0]
        x += 8 + n + n % 2
    if x not in (end, end + 1):
        return None
    if form == b"WAVE" and {b"fmt ", b"data"} <= seen:
        return "audio/wav", size
    if form == b"WEBP" and seen & {b"VP8 ", b"VP8L", b"VP8X"}:
        return "image/webp", size
    return ("video/avi", size) if form == b"AVI " and b"LIST" in seen else None


def _png(b: Data, at: int) -> tuple[str, int] | None:
    x = at + 8
    first = True
    while x + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, x)
        if x + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[x + 4 : x + 8 + n]) != struct.unpack_from(">I", b, x + 8 + n)[0]:
            return None
        x, first = x + 12 + n, False
        if kind == b"IEND":
            return "image/png", x - at
    return None


def _gif(b: Data, at: int) -> tuple[str, int] | None:
    if len(b) < at + 14:
        return None
    flags = b[at + 10]
    x = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(y: int) -> int:
        while y < len(b) and b[y]:
            y += b[y] + 1
        return y + 1

    while x < len(b):
        if b[x] == 0x3B:
            return "image/gif", x + 1 - at
        if b[x] == 0x21:
            x = blocks(x + 2)
        elif b[x] == 0x2C and x + 10 <= len(b):
            x = blocks(x + 11 + (3 << (b[x + 9] & 7) + 1 if b[x + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: Data, at: int) -> tuple[str, int] | None:
    x, frame = at + 2, False
    while x + 4 <= len(b) and b[x] == 0xFF:
        kind, n = b[x + 1], struct.unpack_from(">H", b, x + 2)[0]
        if kind in (0x00, 0xFF, 0xD8) or n < 2:
            return None
        frame |= kind in (0xC0, 0xC1, 0xC2)
        x += 2 + n
        if kind == 0xDA:
            end = b.after(b"\xff\xd9", x)
            return ("image/jpeg", end + 2 - at) if frame and end >= 0 else None
    return None


def _bmp(b: Data, at: int) -> tuple[str, int] | None:
    if len(b) < at + 30:
        return None
    size, _, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    good = header in (40, 108, 124) and 14 + header <= offset <= size <= len(b) - at and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return ("image/bmp", size) if good else None


def _pdf(b: Data, at: int) -> tuple[str, int] | None:
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return None
    x, end = b.after(b"startxref", at), b.after(b"%%EOF", at)
    return ("application/pdf", end + 5 - at) if 0 <= x < end else None


def _zip(b: Data, at: int) -> tuple[str, int] | None:
    end = b.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    n, size, offset, comment = struct.unpack_from("<HIIH", b, end + 10)
    good = at + offset + size == end and (not n or b[at + offset : at + offset + 4] == b"PK\x01\x02")
    return ("application/zip", end + 22 + comment - at) if good else None


def _gzip(b: Data, at: int) -> tuple[str, int] | None:
    d = zlib.decompressobj(31)
    try:
        for k in range(at, len(b), 1 << 16):
            d.decompress(b[k : k + (1 << 16)])
            if d.eof:
                return "application/gzip", min(k + (1 << 16), len(b)) - len(d.unused_data) - at
    except zlib.error:
        pass
    return None


def _ogg(b: Data, at: int) -> tuple[str, int] | None:
    x, pages = at, 0
    while b[x : x + 4] == b"OggS" and x + 27 <= len(b) and b[x + 4] == 0:
        n = b[x + 26]
        x, pages, last = x + 27 + n + sum(b[x + 27 : x + 27 + n]), pages + 1, b[x + 5] & 4
        if x > len(b):
            return None
        if last:
            break
    return ("audio/ogg", x - at) if pages else None


def _flac(b: Data, at: int) -> tuple[str, int] | None:
    x = at + 4
    while x + 4 <= len(b):
        kind, n = b[x], int.from_bytes(b[x + 1 : x + 4], "big")
        if x == at + 4 and (kind & 0x7F or n != 34):
            return None
        x += 4 + n
        if kind & 0x80:
            return ("audio/flac", len(b) - at) if x + 2 <= len(b) and b[x] == 0xFF and b[x + 1] >> 2 == 0x3E else None
    return None


#: Magic bytes of each format and what confirms it.
FORMATS: tuple[tuple[bytes, Callable[[Data, int], tuple[str, int] | None]], ...] = (
    (b"RIFF", _riff), (b"\x89PNG\r\n\x1a\n", _png), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"\xff\xd8\xff", _jpeg), (b"BM", _bmp),
    (b"%PDF-", _pdf), (b"PK\x03\x04", _zip), (b"\x1f\x8b\x08", _gzip), (b"OggS", _ogg), (b"fLaC", _flac),
)


def automaton() -> ahocorasick.Automaton:
    """Over Latin-1 text, whose characters are the bytes."""
    found = ahocorasick.Automaton()
    for k, (magic, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), (k, len(magic)))
    found.make_automaton()
    return found


def sniffed(data: bytes, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, start, length) of the confirmed media, outermost first; inside a confirmed medium the search goes on behind its magic."""
    data, out = Data(data), []
    for end, (k, n) in machine.iter(data.decode("latin-1")):
        if found := FORMATS[k][1](data, end - n + 1):
            out.append((found[0], end - n + 1, found[1]))
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def typed(data: bytes, declared: str | None, machine: ahocorasick.Automaton) -> tuple[str, bool, list[tuple[str, int, int]]]:
    """(type, whether the declared one was another, media that don't cover the whole)."""
    found = sniffed(data, machine)
    whole = next((x for x in found if x[1] == 0 and x[2] == len(data)), None)
    kind = whole[0] if whole else declared or "application/octet-stream"
    return kind, bool(declared) and whole is not None and declared != kind, [x for x in found if x != whole]


def sniff_media(df: DataFrame, data_col: str, declared_col: str | None = None) -> DataFrame:
    """df with media_type (sniffed, else declared, else application/octet-stream), media_wrong (the declared type was another) and
    carved, array<struct<type, start, length>> of the media that don't cover the whole column. Null and empty data have the declared
    type and carve nothing. Columns of df travel in a struct, so that no name can clash; those of the three names are replaced.
    """
    keep = [c for c in df.columns if c not in ("media_type", "media_wrong", "carved")]
    inner = df.select(F.struct(*map(column, keep)).alias("row"), column(data_col).alias("data"), (column(declared_col) if declared_col else F.lit(None).cast("string")).alias("declared"))

    @F.pandas_udf("media_type string, media_wrong boolean, carved array<struct<type:string,start:long,length:long>>")
    def look(data: pd.Series, declared: pd.Series) -> pd.DataFrame:
        machine, rows = automaton(), []
        for b, said in zip(data, declared, strict=True):
            kind, wrong, inside = typed(b or b"", said, machine)
            rows.append((kind, wrong, [{"type": t, "start": s, "length": n} for t, s, n in inside]))
        return pd.DataFrame(rows, columns=["media_type", "media_wrong", "carved"])

    return inner.select("row", look("data", "declared").alias("m")).select("row.*", "m.*")


def text_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, stored as 8-bit samples of a WAV file. The file lies
    inside a carrier of unknown type that is declared as an image; reading back carves the file by its signature and structure, corrects the type of what
    was carved, and takes the samples from it. Null text: empty. Equal texts have equal values, so have repeated rows; ids may be null or tied;
    an empty table gives no rows; only id and text are read.

    The stored bytes live and end inside one task, row by row: only digests and features leave it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for b in batches:
            rows = []
            for text in b["text"]:
                plain = (text or "").encode("utf-8", "surrogatepass")
                stored = CARRIER + wav(plain + bytes(-len(plain) % BLOCK or (0 if plain else BLOCK)))
                _, start, length = next(x for x in typed(stored, DECLARED, machine)[2] if x[0] == "audio/wav")
                carved = stored[start : start + length]
                kind, wrong, found = typed(carved, DECLARED, machine)
                payload = carved[44 : 44 + struct.unpack_from("<I", carved, 40)[0]]
                x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
                turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
                inside = "+".join(f"{t}@{s}:{n}" for t, s, n in found)
                feature = f"{kind}:{length}@{start}{'|corrected' if wrong else ''}|samples={len(x)}|sum={int(x.sum())}|energy={int((x * x).sum())}|crossings={turns}|low={int(x.min())}|high={int(x.max())}|inside={inside}"
                rows.append((len(plain), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], index=b.index)
            yield pd.concat([b[["id"]], out], axis=1)

    inner = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    schema = f"id {inner.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return inner.mapInPandas(run, schema).withColumnRenamed("id", id_col)
