"""Media columns: signature sniffing and carving.

An Aho-Corasick automaton finds every magic number in a blob in one pass; the
validator of each format then confirms the structure and tells the length.  A
hit at offset 0 gives the blob's real type, which corrects the declared one, and
what is left behind it counts as trailing; confirmed hits elsewhere are embedded
media, which are carved.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .kernel import apart, fresh, with_fields

#: The formats' published magic numbers.
MAGIC = {
    "png": b"\x89PNG\r\n\x1a\n",
    "bmp": b"BM",
    "wav": b"RIFF",
    "gif87": b"GIF87a",
    "gif89": b"GIF89a",
    "jpeg": b"\xff\xd8\xff",
    "gzip": b"\x1f\x8b\x08",
    "flac": b"fLaC",
}
WIDTH = 64


# --- writers and readers of losslessly stored 8-bit samples ------------------


def write_png(payload: bytes) -> bytes:
    """Greyscale, 8 bits, 64 samples a row, filter 0."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return MAGIC["png"] + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def read_png(blob: bytes) -> bytes:
    width, rows = struct.unpack(">II", blob[16:24])
    at, packed = 8, []
    while at < len(blob):
        (n,), kind = struct.unpack(">I", blob[at : at + 4]), blob[at + 4 : at + 8]
        if kind == b"IDAT":
            packed.append(blob[at + 8 : at + 8 + n])
        at += n + 12
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, width + 1)[:, 1:].tobytes()


def write_wav(payload: bytes) -> bytes:
    """PCM, mono, 8 bits, 8 kHz."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def read_wav(blob: bytes) -> bytes:
    at = 12
    while at < len(blob):
        kind, (n,) = blob[at : at + 4], struct.unpack("<I", blob[at + 4 : at + 8])
        if kind == b"data":
            return blob[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


_GREYS = bytes(b for k in range(256) for b in (k, k, k, 0))


def write_bmp(payload: bytes) -> bytes:
    """Palette of 256 greys, 64 samples a row, top row first (a negative height)."""
    rows = len(payload) // WIDTH
    return b"BM" + struct.pack("<IHHI", 1078 + len(payload), 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, WIDTH, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 256) + _GREYS + payload


def read_bmp(blob: bytes) -> bytes:
    (start,) = struct.unpack("<I", blob[10:14])
    return blob[start:]


STORES = {"png": (write_png, read_png), "wav": (write_wav, read_wav), "bmp": (write_bmp, read_bmp)}


# --- validators: the length of a well-formed file at `at`, or 0 --------------


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if first and (kind != b"IHDR" or n != 13) or p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, r1, r2, start, head, width, height, planes, depth = struct.unpack("<IHHIIiiHH", b[at + 2 : at + 30])
    if r1 or r2 or head not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    data = (width * depth + 31) // 32 * 4 * abs(height)
    return size if start >= 14 + head and size >= start + data and at + size <= len(b) else 0


def _wav(b: bytes, at: int) -> int:
    if b[at + 8 : at + 16] != b"WAVEfmt ":
        return 0
    size = 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if at + size > len(b):
        return 0
    p, data = at + 12, False
    while p + 8 <= at + size:
        data |= b[p : p + 4] == b"data"
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + n + n % 2
    return size if data and p in (at + size, at + size + 1) else 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    """Segments up to the end mark; a frame header with components, rows and columns has to come before the first scan."""
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2 or p + 2 + n > len(b):
            return 0
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            parts = b[p + 9] if n >= 8 else 0
            if not parts or n != 8 + 3 * parts or not any(b[p + 7 : p + 9]):
                return 0
            frame = True
        if kind == 0xDA:
            if not frame:
                return 0
            p += 2 + n
            while (q := b.find(b"\xff", p)) >= 0 and q + 1 < len(b):
                if b[q + 1] == 0xD9:
                    return q + 2 - at
                if b[q + 1] and not 0xD0 <= b[q + 1] <= 0xD7:
                    p = q
                    break
                p = q + 2
            else:
                return 0
            continue
        p += 2 + n
    return 0


def _gzip(b: bytes, at: int) -> int:
    """Flags have to be defined ones; the stream has to inflate with the right sum."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    unpack, p = zlib.decompressobj(31), at
    try:
        while not unpack.eof and p < len(b):
            unpack.decompress(b[p : p + 65536], 1 << 20)
            while unpack.unconsumed_tail:
                unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            p += 65536
    except (zlib.error, gzip.BadGzipFile):
        return 0
    return min(p, len(b)) - len(unpack.unused_data) - at if unpack.eof else 0


def _crc_table(bits: int, polynomial: int) -> list[int]:
    out, top, mask = [], 1 << bits - 1, (1 << bits) - 1
    for k in range(256):
        crc = k << bits - 8
        for _ in range(8):
            crc = (crc << 1 ^ polynomial) & mask if crc & top else crc << 1 & mask
        out.append(crc)
    return out


#: The format's polynomials, and the samples of a block by their code (0: 8 or 16 bits follow the header).
_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_BLOCK = [0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]


def _flac_frame(b: bytes, p: int) -> tuple[int, int]:
    """(length of the header, samples of the block) of a well-formed frame header at p, or (0, 0)."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or not b[p + 2] >> 4 or b[p + 2] & 15 == 15 or b[p + 3] >> 4 > 10 or b[p + 3] & 1:
        return 0, 0
    first, q = b[p + 4], p + 5
    more = 0 if first < 0x80 else next((k for k in range(1, 7) if not first >> 6 - k & 1), 7) if first >= 0xC0 else -1
    if more < 0 or q + more > len(b) or any(x & 0xC0 != 0x80 for x in b[q : q + more]):
        return 0, 0
    q += more
    size, rate = b[p + 2] >> 4, b[p + 2] & 15
    samples, wide = _BLOCK[size], {6: 1, 7: 2}.get(size, 0)
    if wide:
        samples = int.from_bytes(b[q : q + wide], "big") + 1
    q += wide + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in b[p:q]:
        crc = _CRC8[crc ^ x]
    return (q + 1 - p, samples) if q < len(b) and crc == b[q] else (0, 0)


def _flac(b: bytes, at: int) -> int:
    """Metadata blocks have to be well formed; frames are walked by the checks of their headers and ends until the stream has its samples."""
    p, first, last = at + 4, True, False
    total = 0
    while not last:
        if p + 4 > len(b):
            return 0
        kind, n = b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind or n != 34) or kind == 127 or p + 4 + n > len(b):
            return 0
        if first:
            total = int.from_bytes(b[p + 17 : p + 22], "big") & (1 << 36) - 1
        last, p, first = bool(b[p] & 128), p + 4 + n, False
    left = total
    while total and left > 0:
        head, samples = _flac_frame(b, p)
        if not head:
            return 0
        crc = 0
        for x in b[p : p + head]:
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ x]
        end = 0
        for q in range(p + head, len(b)):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[q]]
            # The sum over a frame and its own check is 0; another frame follows unless the samples are all there.
            if not crc and q >= p + head + 2 and (left <= samples or _flac_frame(b, q + 1)[0]):
                end = q + 1
                break
        if not end:
            return 0
        p, left = end, left - samples
    return p - at if total else 0


VALIDATORS = {"png": _png, "bmp": _bmp, "wav": _wav, "gif87": _gif, "gif89": _gif, "jpeg": _jpeg, "gzip": _gzip, "flac": _flac}


@cache
def automaton() -> ahocorasick.Automaton:
    """Over bytes as Latin-1 text."""
    found = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the well-formed media in a blob, outermost only, in order."""
    found, end = [], 0
    for last, (kind, n) in automaton().iter(blob.decode("latin-1")):
        at = last - n + 1
        if at >= end and (size := VALIDATORS[kind](blob, at)):
            found.append((at, size, kind.rstrip("789")))
            end = at + size
    return found


@dataclass(frozen=True)
class Inspected:
    kind: str
    corrected: bool  # whether that differs from the declared type
    embedded: list[tuple[int, int, str]]  # offset, length, type
    trailing: int  # bytes after media at offset 0 that are in no embedded media


def inspect(blob: bytes | None, declared: str | None) -> Inspected:
    """What a blob is and holds.

    The type is that of media at offset 0, else the declared one where there are
    no media of that type to find, else `unknown`; a null blob is empty.
    """
    blob = blob or b""
    found = sniff(blob)
    own = [f for f in found if f[0] == 0]
    kind = own[0][2] if own else declared if declared is not None and declared not in {k.rstrip("789") for k in MAGIC} else "unknown"
    return Inspected(kind, kind != declared, [f for f in found if f[0]], len(blob) - sum(n for _, n, _ in found) if own else 0)


def sniff_media(blobs: DataFrame, blob: str = "blob", declared: str = "declared", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns with media_type, corrected, embedded (offset, length, type, bytes) and trailing (bytes) of each row.

    Rows are kept as they are: null blobs are empty and `unknown`, repeated rows
    stay, blobs of any length are read whole, and an empty table gives an empty
    one; columns named as the outputs give way.
    """
    outputs = ["media_type", "corrected", "embedded", "trailing"]
    keep = apart(["doc_id"] if keep is None else keep, outputs)
    names = fresh("__blob", keep), fresh("__declared", keep)
    given = blobs.select(*keep, F.col(blob).cast("binary").alias(names[0]), F.col(declared).cast("string").alias(names[1]))
    schema = with_fields(given.drop(*names).schema, "media_type string, corrected boolean, embedded array<struct<offset: long, length: long, type: string, bytes: binary>>, trailing long")
    arrow = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())]))

    def run(batches):
        for batch in batches:
            raws = [x.as_py() or b"" for x in batch.column(batch.num_columns - 2)]
            found = [inspect(raw, d) for raw, d in zip(raws, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            inner = [[{"offset": o, "length": n, "type": t, "bytes": raw[o : o + n]} for o, n, t in f.embedded] for raw, f in zip(raws, found, strict=True)]
            more = [pa.array([f.kind for f in found], pa.string()), pa.array([f.corrected for f in found], pa.bool_()), pa.array(inner, arrow), pa.array([f.trailing for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *more], names=[*batch.schema.names[:-2], *outputs])

    return given.mapInArrow(run, schema)


def pack(text: bytes, kind: str) -> bytes:
    """The stored form: zero bytes are added up to a positive multiple of 64."""
    return STORES[kind][0](text + bytes(-len(text) % WIDTH or (0 if text else WIDTH)))


def choose(text: bytes) -> str:
    """The format that a text is stored in: one of three, by its checksum."""
    return sorted(STORES)[zlib.crc32(text) % len(STORES)]


#: What stands before and after media in a container.
HEAD, TAIL = b"--part\r\nContent-Type: application/octet-stream\r\n\r\n", b"\r\n--part--\r\n"


def in_container(text: bytes) -> bool:
    """Whether a text's media are stored in a container: one text of three, by its checksum."""
    return zlib.crc32(text) // 9 % 3 == 0


def store(text: bytes) -> tuple[bytes, str]:
    """(stored form, declared type): media under a type that need not be theirs, or a container that holds them, which is of no type to find."""
    blob = pack(text, choose(text))
    if in_container(text):
        return HEAD + blob + TAIL, "container"
    return blob, sorted(STORES)[zlib.crc32(text) // 3 % 3]


def payload_of(blob: bytes, seen: Inspected) -> bytes:
    """What is stored: of the blob itself, or of the first media carved out of it."""
    kind, part = (seen.kind, blob) if seen.kind in STORES else next((t, blob[o : o + n]) for o, n, t in seen.embedded if t in STORES)
    return STORES[kind][1](part)


def each_text(documents: DataFrame, row: Callable[[bytes], tuple], schema: str, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns with what row(text bytes) returns.

    A null text is empty; texts of any length are given whole; repeated rows stay,
    and an empty table gives an empty one.  Columns named as what it returns give way.
    """
    keep = apart(["doc_id"] if keep is None else keep, StructType.fromDDL(schema).names)
    name = fresh("__text", keep)
    given = documents.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias(name))
    out = with_fields(given.drop(name).schema, schema)
    names = [f.name for f in out][len(keep) :]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [row(x.as_py()) for x in part.column(part.num_columns - 1)]
                more = [pa.array(list(c)) for c in zip(*rows, strict=True)] if rows else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[*part.schema.names[:-1], *names])

    return given.mapInArrow(run, out)
