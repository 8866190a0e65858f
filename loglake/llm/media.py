"""Media columns: PNG images in binary columns, read back chunk by chunk, with perceptual hashes.

The codec is written here on zlib and numpy: 8-bit greyscale, no interlacing, all five row filters on
reading. Every chunk's CRC is tested. The feature is a low-frequency cosine-transform hash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import in_small_batches

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
HASH_GRID, HASH_LOW = 32, 8


class BrokenImage(ValueError):
    """The bytes are not a PNG that this codec reads, or a checksum does not hold."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(pixels: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG. The first row is stored as differences to the left, later rows to the row above."""
    rows = np.asarray(pixels, np.uint8)
    height, width = rows.shape
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = 2
    lines[1:, 1:] = rows[1:] - rows[:-1]
    if height:
        lines[0, 0], lines[0, 1:] = 1, np.diff(rows[0], prepend=np.uint8(0))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _average(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left = np.empty_like(line), 0
    for i, (x, b) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        out[i] = left = (x + ((left + b) >> 1)) & 255
    return out


def _paeth(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left, corner = np.empty_like(line), 0, 0
    for i, (x, b) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        da, db, dc = abs(b - corner), abs(left - corner), abs(left + b - 2 * corner)
        near = left if da <= db and da <= dc else b if db <= dc else corner
        out[i] = left = (x + near) & 255
        corner = b
    return out


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Rows with a leading filter byte to pixels; stretches of rows with one simple filter go in one numpy call."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise BrokenImage("unknown row filter")
    edges = [*np.flatnonzero(np.diff(kinds.astype(np.int16), prepend=-1)), len(kinds)]
    zero = np.zeros(out.shape[1], np.uint8)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        kind, above = kinds[a], out[a - 1] if a else zero
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a] += above
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind > 2:
            for i in range(a, b):
                out[i] = (_average if kind == 3 else _paeth)(out[i], out[i - 1] if i else zero)
    return out


def png_decode(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit greyscale PNG; raises :class:`BrokenImage` on any damage."""
    if data[:8] != SIGNATURE:
        raise BrokenImage("no PNG signature")
    at, shape, packed, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(data):
            raise BrokenImage("truncated chunk")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(data[at + 4 : at + 8 + size]):
            raise BrokenImage("chunk checksum")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, lace) != (8, 0, 0):
                raise BrokenImage("only 8-bit greyscale without interlacing")
            shape = (height, width)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if shape is None or not ended:
        raise BrokenImage("a required chunk is missing")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise BrokenImage(str(e)) from e
    if len(raw) != shape[0] * (shape[1] + 1):
        raise BrokenImage("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(shape[0], shape[1] + 1))


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5)[None, :] * np.arange(low)[:, None] / n)


_COS = _cosines(HASH_GRID, HASH_LOW)


def shrink(pixels: np.ndarray, grid: int = HASH_GRID) -> np.ndarray:
    """Means over a grid x grid partition of the image; an axis shorter than the grid repeats its pixels."""
    out = pixels.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        edges = np.arange(grid + 1) * n // grid
        starts = np.minimum(edges[:-1], n - 1)
        spans = np.maximum(edges[1:] - edges[:-1], 1)
        sums = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis=axis)], axis=axis)
        out = (sums.take(starts + spans, axis) - sums.take(starts, axis)) / spans.reshape((-1, 1) if axis == 0 else (1, -1))
    return out


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits, as hex: which low-frequency coefficients exceed their median, the constant one left out of it."""
    if not pixels.size:
        return "0" * 16
    low = np.round(_COS @ shrink(pixels) @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def store(payload: bytes) -> tuple[bytes, int]:
    """The padded payload as an image of ``WIDTH`` columns, and the padded length."""
    size = max(64, -(-len(payload) // 64) * 64)
    padded = np.zeros(size, np.uint8)
    padded[: len(payload)] = np.frombuffer(payload, np.uint8)
    return png_encode(padded.reshape(-1, WIDTH)), size


def to_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with its text stored as PNG bytes in a binary column, which replaces one of that name. Null and empty texts become one row of zeros."""
    docs = docs.drop(media) if media != text else docs
    schema = StructType([*docs.schema, StructField(media, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch, text):
                made = pa.array([store((t.as_py() or "").encode())[0] for t in part.column(text)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, media])

    return docs.mapInArrow(run, schema)


def _small(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch, so that few long values share one."""
    per = max(1, int(batch.num_rows * most / max(1, batch.column(column).nbytes)))
    for i in range(0, batch.num_rows, per):
        yield batch.slice(i, per)


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def describe(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the stored bytes back and returns digests and the hash of what was read.

    Equal texts give equal values; each row stands alone, so ties, repeats and empty tables need no rule.
    A null text counts as empty: 64 zero bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = (text.as_py() or "").encode()
                blob, _ = store(own)
                pixels = png_decode(blob)
                back = pixels.tobytes()
                rows.append((doc, len(own), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), cosine_hash(pixels)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, FEATURES)
