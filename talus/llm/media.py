"""Media columns: signature sniffing, type correction and carving of embedded media.

An Aho-Corasick automaton finds every magic sequence of a blob in one pass; a validator of the
format then checks structure and lengths at each place, so that chance hits fall away.  The
operator corrects declared types and cuts embedded media out of larger blobs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import documents, keyed_text, slices

#: A payload is padded with blanks to a positive multiple of this: one row of 64 RGB samples.
ROW = 192

# ---- formats -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Found:
    """A validated media object inside a blob: type, extent and a short description."""

    kind: str
    at: int
    size: int
    about: str


def bmp_bytes(payload: bytes) -> bytes:
    """24-bit bitmap, 64 samples a row, top row first."""
    height = len(payload) // ROW
    info = struct.pack("<IiiHHIIiiII", 40, ROW // 3, -height, 1, 24, 0, len(payload), 2835, 2835, 0, 0)
    return struct.pack("<2sIHHI", b"BM", 54 + len(payload), 0, 0, 54) + info + payload


def check_bmp(blob: bytes, at: int) -> Found | None:
    if len(blob) - at < 54:
        return None
    size, r1, r2, start, head = struct.unpack_from("<IHHII", blob, at + 2)
    width, height, planes, bits, packing, area = struct.unpack_from("<iiHHII", blob, at + 18)
    rows = abs(height)
    if r1 or r2 or head != 40 or start != 54 or planes != 1 or bits != 24 or packing or width <= 0 or not rows:
        return None
    stride = (3 * width + 3) // 4 * 4
    if size != 54 + stride * rows or area not in (0, stride * rows) or at + size > len(blob):
        return None
    return Found("image/bmp", at, size, f"{width}x{rows}")


def bmp_payload(media: bytes) -> bytes:
    width, height = struct.unpack_from("<ii", media, 18)
    stride, n = (3 * width + 3) // 4 * 4, 3 * width
    rows = [media[54 + k * stride : 54 + k * stride + n] for k in range(abs(height))] if stride != n else [media[54:]]
    return b"".join(rows[::-1] if height > 0 and len(rows) > 1 else rows)


def wav_bytes(payload: bytes) -> bytes:
    """8-bit mono samples at 8 kHz."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def _wav_chunks(blob: bytes, at: int, end: int):
    p = at + 12
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", blob, p)
        if p + 8 + n > end:
            return
        yield name, p + 8, n
        p += 8 + n + (n & 1)


def check_wav(blob: bytes, at: int) -> Found | None:
    if len(blob) - at < 12 or blob[at + 8 : at + 12] != b"WAVE":
        return None
    size = 8 + struct.unpack_from("<I", blob, at + 4)[0]
    if at + size > len(blob):
        return None
    chunks = {name: (p, n) for name, p, n in _wav_chunks(blob, at, at + size)}
    if b"fmt " not in chunks or b"data" not in chunks or chunks[b"fmt "][1] < 16:
        return None
    code, channels, rate, speed, block, bits = struct.unpack_from("<HHIIHH", blob, chunks[b"fmt "][0])
    if code != 1 or not channels or bits not in (8, 16, 24, 32) or block != channels * bits // 8 or speed != rate * block:
        return None
    if chunks[b"data"][1] % block:
        return None
    return Found("audio/wav", at, size, f"{channels}ch{bits}b{rate}hz{chunks[b'data'][1] // block}")


def wav_payload(media: bytes) -> bytes:
    return b"".join(media[p : p + n] for name, p, n in _wav_chunks(media, 0, len(media)) if name == b"data")


PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def _png_chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png_bytes(payload: bytes) -> bytes:
    """8-bit RGB image, 64 samples a row, no row filter."""
    height = len(payload) // ROW
    rows = b"".join(b"\0" + payload[k * ROW : (k + 1) * ROW] for k in range(height))
    head = struct.pack(">IIBBBBB", ROW // 3, height, 8, 2, 0, 0, 0)
    return PNG_MAGIC + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", zlib.compress(rows, 1)) + _png_chunk(b"IEND", b"")


def _png_chunks(blob: bytes, at: int):
    p = at + 8
    while p + 12 <= len(blob):
        n, name = struct.unpack_from(">I4s", blob, p)
        if p + 12 + n > len(blob) or struct.unpack_from(">I", blob, p + 8 + n)[0] != zlib.crc32(blob[p + 4 : p + 8 + n]):
            return
        yield name, p + 8, n
        p += 12 + n


def check_png(blob: bytes, at: int) -> Found | None:
    first = end = None
    has_data = False
    for name, p, n in _png_chunks(blob, at):
        if first is None:
            if name != b"IHDR" or n != 13:
                return None
            first = struct.unpack_from(">IIBBBBB", blob, p)
        has_data |= name == b"IDAT"
        if name == b"IEND":
            end = p + n + 4
            break
    if end is None or not has_data or not first[0] or not first[1] or first[2] not in (1, 2, 4, 8, 16):
        return None
    return Found("image/png", at, end - at, f"{first[0]}x{first[1]}")


def png_payload(media: bytes) -> bytes:
    parts = {b"IHDR": b"", b"IDAT": b""}
    for name, p, n in _png_chunks(media, 0):
        if name in parts:
            parts[name] += media[p : p + n]
    width, height, bits, colour, *_ = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if (bits, colour) != (8, 2):
        raise ValueError("only 8-bit RGB images are decoded")
    rows, n = zlib.decompress(parts[b"IDAT"]), 3 * width
    lines = [rows[k * (n + 1) : (k + 1) * (n + 1)] for k in range(height)]
    if any(line[:1] != b"\0" for line in lines):
        raise ValueError("only unfiltered rows are decoded")
    return b"".join(line[1:] for line in lines)


def au_bytes(payload: bytes) -> bytes:
    """8-bit linear mono samples at 8 kHz."""
    return struct.pack(">4sIIIII", b".snd", 24, len(payload), 2, 8000, 1) + payload


def check_au(blob: bytes, at: int) -> Found | None:
    if len(blob) - at < 24:
        return None
    start, n, code, rate, channels = struct.unpack_from(">IIIII", blob, at + 4)
    if start != 24 or code != 2 or not 1 <= channels <= 16 or not 1000 <= rate <= 384_000 or n % channels or at + start + n > len(blob):
        return None
    return Found("audio/basic", at, start + n, f"{channels}ch8b{rate}hz{n // channels}")


def au_payload(media: bytes) -> bytes:
    return media[24:]


#: Magic sequence, writer, validator and reader of each format.
FORMATS: dict[str, tuple[bytes, Callable, Callable, Callable]] = {
    "image/bmp": (b"BM", bmp_bytes, check_bmp, bmp_payload),
    "audio/wav": (b"RIFF", wav_bytes, check_wav, wav_payload),
    "image/png": (PNG_MAGIC, png_bytes, check_png, png_payload),
    "audio/basic": (b".snd", au_bytes, check_au, au_payload),
}

# ---- sniffing ------------------------------------------------------------------------------

_AUTOMATON = None


def automaton():
    """The automaton over all magic sequences, one for each worker process (bytes read as Latin-1)."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for kind, (magic, *_) in FORMATS.items():
            _AUTOMATON.add_word(magic.decode("latin-1"), (kind, len(magic)))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def sniff_blob(blob: bytes) -> list[Found]:
    """All validated objects that do not lie inside an earlier one, by place."""
    found: list[Found] = []
    free = 0
    for last, (kind, n) in automaton().iter(blob.decode("latin-1")):
        at = last + 1 - n
        if at >= free and (object_ := FORMATS[kind][2](blob, at)):
            found.append(object_)
            free = at + object_.size
    return found


SNIFFED = "row_id long, declared string, kind string, corrected boolean, ordinal int, at long, size long, about string, media binary"


def sniff(df: DataFrame, id_col: str, blob_col: str, declared_col: str | None = None) -> DataFrame:
    """One row per media object found in a binary column, with its place and the bytes carved out.

    A blob without any object (null and empty ones too) gives one row of null kind.  `corrected`
    tells that the declared type is not that of an object which fills the blob.  Repeated rows
    repeat; an empty table gives no row; other columns are ignored.
    """

    def run(batches):
        for batch in slices(batches):
            rows = []
            for i, blob, declared in zip(*(c.to_pylist() for c in batch.columns)):
                objects = sniff_blob(blob) if blob else []
                for k, x in enumerate(objects):
                    whole = x.at == 0 and x.size == len(blob)
                    rows.append((i, declared, x.kind, whole and declared != x.kind, k, x.at, x.size, x.about, blob[x.at : x.at + x.size]))
                if not objects:
                    rows.append((i, declared, None, False, 0, None, None, None, None))
            yield _batch(rows, _SNIFF_SCHEMA)

    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(blob_col).alias("blob"), declared.alias("declared")).mapInArrow(run, SNIFFED)


_SNIFF_SCHEMA = pa.schema(
    [("row_id", pa.int64()), ("declared", pa.string()), ("kind", pa.string()), ("corrected", pa.bool_()), ("ordinal", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("about", pa.string()), ("media", pa.binary())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# ---- texts as samples ----------------------------------------------------------------------

STORED = "doc_id long, n_bytes long, declared string, media binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_objects int, corrected boolean"


def padded(data: bytes) -> bytes:
    return data + b" " * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def store_text(data: bytes) -> tuple[str, bytes]:
    """Samples of one text in the format that its checksum picks, so that equal texts are stored alike."""
    payload = padded(data)
    kind = tuple(FORMATS)[zlib.crc32(payload) % len(FORMATS)]
    return kind, FORMATS[kind][1](payload)


_STORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("media", pa.binary())])


def text_media(docs: DataFrame) -> DataFrame:
    """Store every whole text (null: empty) as a media object; the declared type is left generic."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                rows.append((i, len(data), "application/octet-stream", store_text(data)[1]))
            yield _batch(rows, _STORE_SCHEMA)

    return keyed_text(docs).mapInArrow(run, STORED)


def media_digest(media: DataFrame) -> DataFrame:
    """Sniff each stored object, read its samples back and digest them.

    Expects doc_id, n_bytes, declared and media.  The payload comes from the object that fills
    the blob; a blob without one raises, since storage would have lost data.
    """

    def run(batches):
        for batch in slices(batches, 3):
            rows = []
            for i, n, declared, blob in zip(*(c.to_pylist() for c in batch.columns)):
                objects = sniff_blob(blob)
                if not objects or (objects[0].at, objects[0].size) != (0, len(blob)):
                    raise ValueError(f"row {i}: the stored bytes hold no complete object")
                x = objects[0]
                payload = FORMATS[x.kind][3](blob)
                rows.append(
                    (i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), f"{x.kind} {x.about}", len(objects), declared != x.kind)
                )
            yield _batch(rows, _DIGEST_SCHEMA)

    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, DIGEST)


_DIGEST_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_objects", pa.int32()), ("corrected", pa.bool_())]
)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text is empty and padded to one row; repeated rows repeat; an empty table gives no row."""
    return media_digest(text_media(documents(spark, sf_dir)))


QUERIES = {"op1_media_columns": op1_media_columns}
ORACLES: dict[str, str] = {}
