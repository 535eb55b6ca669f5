"""Media columns: Netpbm and BMP images to arrays, tiles and difference hashes.

An image is decoded to a numpy array, area-resized through its integral image
and kept as an NPY tile with a 64-bit difference hash. A payload of any bytes
can be stored as the samples of a grey map and read back without loss.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow

WIDTH = 64
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    at, found = 2, []
    for _ in range(count):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("short Netpbm header")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, with comments, any maxval and 16-bit samples; grey is (h, w), colour (h, w, 3).

    Bitmaps give 0 (black) and 1 (white). Malformed or short data raise ValueError.
    """
    return _netpbm(data)[0]


def _netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """The image and the sample value that stands for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap = kind in (b"P1", b"P4")
    dims, at = _header(data, 2 if bitmap else 3)
    w, h = dims[:2]
    top = 1 if bitmap else dims[2]
    if w <= 0 or h <= 0 or not 0 < top < 65536:
        raise ValueError("bad Netpbm dimensions")
    channels = 3 if kind in (b"P3", b"P6") else 1
    shape = (h, w, 3) if channels == 3 else (h, w)
    n = h * w * channels
    if kind == b"P4":
        row = (w + 7) // 8
        raw = np.frombuffer(data, np.uint8, -1, at + 1)
        if raw.size < row * h:
            raise ValueError("short Netpbm raster")
        return 1 - np.unpackbits(raw[: row * h].reshape(h, row), axis=1)[:, :w], 1
    if kind == b"P1":
        bits = re.sub(rb"#[^\r\n]*|\s", b"", data[at:])[:n]
        if len(bits) < n:
            raise ValueError("short Netpbm raster")
        return (1 - (np.frombuffer(bits, np.uint8) - 48)).astype(np.uint8).reshape(shape), 1
    depth = np.dtype(np.uint8 if top < 256 else ">u2")
    if kind in (b"P2", b"P3"):
        values = re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:n]
        if len(values) < n:
            raise ValueError("short Netpbm raster")
        return np.array([int(v) for v in values], np.uint8 if top < 256 else np.uint16).reshape(shape), top
    if len(data) - at - 1 < n * depth.itemsize:
        raise ValueError("short Netpbm raster")
    out = np.frombuffer(data, depth, n, at + 1).reshape(shape)
    return (out if top < 256 else out.astype(np.uint16)), top


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits, either row order, to (h, w, 3) RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, head, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if head < 40 or packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or (packing == 3 and bits != 32):
        raise ValueError("unsupported BMP encoding")
    flip, h = h > 0, abs(h)
    stride = (w * bits + 31) // 32 * 4
    if w <= 0 or h == 0 or len(data) < start + stride * h:
        raise ValueError("short BMP raster")
    rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
    if bits <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.zeros((256, 3), np.uint8)
        given = np.frombuffer(data, np.uint8, 4 * min(used, (start - 14 - head) // 4), 14 + head).reshape(-1, 4)
        palette[: len(given)] = given[:, 2::-1]
        if bits == 8:
            index = rows[:, :w]
        elif bits == 4:
            index = np.stack((rows >> 4, rows & 15), -1).reshape(h, -1)[:, :w]
        else:
            index = np.unpackbits(rows, axis=1)[:, :w]
        image = palette[index]
    elif bits == 16:
        v = rows[:, : 2 * w].copy().view("<u2")
        image = (np.stack(((v >> 10) & 31, (v >> 5) & 31, v & 31), -1).astype(np.uint16) * 255 // 31).astype(np.uint8)
    else:
        image = rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]
    return image[::-1] if flip else image


def decode(data: bytes) -> np.ndarray:
    return decode_with_white(data)[0]


def decode_with_white(data: bytes) -> tuple[np.ndarray, int]:
    """The image and the sample value that stands for white: a Netpbm image's maxval, 1 of a bitmap, 255 of a BMP."""
    return (decode_bmp(data), 255) if data[:2] == b"BM" else _netpbm(data)


def encode_grey(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload, a multiple of ``width`` bytes, as the samples of a binary grey map."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


#: Samples of the rows whose integral image is in memory at once.
_STRIP = 1 << 20


def _integral_rows(image: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The integral image at the wanted rows (sorted, each once), as float64, from strips of the image."""
    rows, cols = image.shape[:2]
    out = np.zeros((len(wanted), cols + 1, *image.shape[2:]))
    before = np.zeros((cols + 1, *image.shape[2:]))
    step = max(1, _STRIP // max(1, image[:1].size))
    for a in range(0, rows, step):
        strip = image[a : a + step]
        total = np.zeros((len(strip) + 1, cols + 1, *image.shape[2:]))
        np.cumsum(strip, axis=0, out=total[1:, 1:], dtype=np.float64)
        np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])
        total += before
        here = np.flatnonzero((wanted >= a) & (wanted <= a + len(strip)))
        out[here] = total[wanted[here] - a]
        before = total[-1].copy()
    return out


def area_resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over each target cell's exact area, from the integral image, as float64."""
    rows, cols = image.shape[:2]

    def ends(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        edges = np.arange(n + 1) * (size / n)
        low = np.minimum(edges.astype(np.int64), size - 1)
        return low, edges - low

    def between(low: np.ndarray, high: np.ndarray, part: np.ndarray) -> np.ndarray:
        part = part.reshape(-1, *[1] * (low.ndim - 1))
        return np.diff(low * (1 - part) + high * part, axis=0)

    low, part = ends(h, rows)
    wanted = np.unique(np.concatenate((low, low + 1)))
    total = _integral_rows(image, wanted)
    down = between(total[np.searchsorted(wanted, low)], total[np.searchsorted(wanted, low + 1)], part).swapaxes(0, 1)
    low, part = ends(w, cols)
    across = between(down[low], down[low + 1], part).swapaxes(0, 1)
    return across / (rows * cols / (h * w))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits, in hex: whether each of 8 x 8 cells is darker than its right neighbour."""
    cells = np.rint(area_resize(grey(image), 8, 9) * 256).astype(np.int64)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, h: int, w: int, white: int | None = None) -> bytes:
    """The resized image as the bytes of an NPY file of 8-bit samples, of which 255 is ``white``.

    Without ``white`` it is the greatest value of the image's type. What the samples
    are doesn't count: a dark image stays dark.
    """
    tile = area_resize(image, h, w) * (255 / (white or np.iinfo(image.dtype).max))
    out = io.BytesIO()
    np.lib.format.write_array(out, np.clip(np.rint(tile), 0, 255).astype(np.uint8), version=(1, 0))
    return out.getvalue()


TILE_SCHEMA = "height int, width int, channels int, tile binary, dhash string, error string"


def media_tiles(df: DataFrame, key: str = "id", media: str = "media", size: int = 32) -> DataFrame:
    """Decode ``media`` and return one row per input row: ``key`` and ``TILE_SCHEMA``.

    A null or undecodable image gives null fields and its ``error``; other columns
    are ignored, whatever their names; repeated rows have equal results. Images are
    handled one at a time, so memory is one image's.
    """
    source = df.select(F.col(key).alias("id"), F.col(media).cast("binary").alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1):
                try:
                    data = data.as_py()
                    if data is None:
                        raise ValueError("no image")
                    image, white = decode_with_white(data)
                    rows.append((*image.shape[:2], 1 if image.ndim == 2 else 3, npy_tile(image, size, size, white), difference_hash(image), None))
                except (ValueError, struct.error) as e:
                    rows.append((None, None, None, None, None, str(e)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, "height", "width", "channels", "tile", "dhash", "error"])

    return map_in_arrow(source, run, f"{key} {source.schema['id'].dataType.simpleString()}, {TILE_SCHEMA}")


def text_media(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 32) -> DataFrame:
    """Store each text as a grey map, read it back and digest what was read.

    The payload is the text's UTF-8 (null: empty) with zero bytes up to a positive
    multiple of 64. One row per input row; equal texts give equal values.
    """
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    schema = (
        f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, tile_bytes long, tile_sha256 string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column(1):
                raw = (cell.as_py() or "").encode("utf-8", "surrogatepass")
                stored = encode_grey(raw + b"\0" * (-len(raw) % WIDTH or WIDTH * (not raw)))
                image = decode(stored)
                back = image.tobytes()
                tile = npy_tile(image, size, size)
                out.append((
                    len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored),
                    hashlib.sha256(stored).hexdigest(), difference_hash(image), len(tile), hashlib.sha256(tile).hexdigest(),
                ))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_bytes", "tile_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=names)

    return map_in_arrow(source, run, schema)
