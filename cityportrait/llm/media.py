"""Media columns: Netpbm and BMP images, area-resized by integral images, NPY tiles and difference hashes.

`decode` reads PGM, PPM (binary) and uncompressed 8- and 24-bit BMP into numpy arrays (rows, columns, channels).
`resize` averages areas exactly with an integral image. `tile` writes an array as NPY bytes. `difference_hash`
compares neighbours of a 9 x 8 grey image.

A text becomes an image as follows: its UTF-8 bytes, padded with spaces to a positive multiple of 192, are the
samples of a PPM image 64 pixels wide, so a row holds 192 bytes. The stored bytes are decoded again, and everything
returned is computed from what was read back.

Cases: null and empty texts give one row of spaces; equal texts give equal values; repeated rows each get a row; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cityportrait.llm.common import mapped

UNIT = 192
WIDTH = 64
TILE = 16
TAIL = 16
RESIZE_ROWS = 4096


def encode_ppm(pixels: np.ndarray) -> bytes:
    """A binary PPM (three channels) or PGM (one)."""
    h, w, c = pixels.shape
    return b"P%d\n%d %d\n255\n" % (6 if c == 3 else 5, w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP; rows from the bottom, each padded to four bytes, blue first."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    c = {b"P5": 1, b"P6": 3}[data[:2]]
    if top > 255:
        raise ValueError("only 8-bit samples")
    return np.frombuffer(data, np.uint8, h * w * c, at + 1).reshape(h, w, c)


def _decode_bmp(data: bytes) -> np.ndarray:
    begin, _, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed BMP of 8 or 24 bits")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, begin).reshape(abs(h), stride)[:, : w * bits // 8]
    if bits == 8:
        size, = struct.unpack_from("<I", data, 14)
        colours = np.frombuffer(data, np.uint8, begin - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
        out = colours[rows]
    else:
        out = rows.reshape(abs(h), w, 3)[:, :, ::-1]
    return out[::-1] if h > 0 else out


def decode(data: bytes) -> np.ndarray:
    """(rows, columns, channels) of an image; ValueError for any other data."""
    if data[:2] in (b"P5", b"P6"):
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _area_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Integrals of a step function over [edges[i], edges[i + 1]) along axis 0, by its running sums."""
    whole = np.floor(edges).astype(np.int64)
    part = edges - whole
    run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    step = np.concatenate([values, np.zeros((1, *values.shape[1:]))])
    at = run[whole] + step[whole] * part.reshape(-1, *[1] * (values.ndim - 1))
    return np.diff(at, axis=0)


def resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area average to (rows, columns, channels). Columns are reduced first, by bands of rows, to bound memory."""
    h, w, _ = pixels.shape
    across = np.linspace(0, w, columns + 1)
    bands = [
        _area_sums(pixels[i : i + RESIZE_ROWS].transpose(1, 0, 2).astype(np.float64), across).transpose(1, 0, 2)
        for i in range(0, h, RESIZE_ROWS)
    ]
    down = _area_sums(np.concatenate(bands), np.linspace(0, h, rows + 1))
    return down / ((h / rows) * (w / columns))


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.mean(axis=2, keepdims=True)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 8 cells is darker than its right neighbour."""
    small = np.round(resize(grey(pixels.astype(np.float64)), 8, 9)[:, :, 0], 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """A side x side thumbnail as NPY bytes."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def text_image(text: str | None) -> tuple[int, bytes]:
    """The number of UTF-8 bytes, and the stored image."""
    data = (text or "").encode("utf-8", "surrogatepass")
    padded = data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")
    return len(data), encode_ppm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH, 3))


def image_text(media: bytes, n_bytes: int) -> str:
    return decode(media).tobytes()[:n_bytes].decode("utf-8", "surrogatepass")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, npy binary"


def digests(docs: DataFrame) -> DataFrame:
    """What is read back from every document's stored image, and its NPY tile; feature: difference hash and the tile's digest."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                n, media = text_image(x.as_py())
                pixels = decode(media)
                payload = pixels.tobytes()
                npy = tile(pixels)
                small = hashlib.sha256(npy).hexdigest()[:16]
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(pixels)}:{small}", npy))
            columns = list(zip(*rows, strict=True)) or [[]] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)


def tiles(media: DataFrame, side: int = TILE) -> DataFrame:
    """doc_id, media -> doc_id, npy (binary tile), dhash; null where the image can't be decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            npy, hashes = [], []
            for x in batch.column(1):
                try:
                    pixels = decode(x.as_py() or b"")
                    npy.append(tile(pixels, side))
                    hashes.append(difference_hash(pixels))
                except (ValueError, KeyError, struct.error):
                    npy.append(None)
                    hashes.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(npy, pa.binary()), pa.array(hashes, pa.string())], ["doc_id", "npy", "dhash"])

    return mapped(media.select("doc_id", "media"), run, "doc_id long, npy binary, dhash string")
