"""Media columns: Netpbm and BMP as numpy arrays, area-resized by integral images, NPY tiles, difference hashes.

An image column holds whole files as binary. Every text can be stored as one: its UTF-8 bytes, padded with zero
bytes to a positive multiple of the width, are the samples of an 8-bit grey file: by a checksum of the payload, half
of the texts become Netpbm files and half BMP files, equal texts equal files.

Edge cases: a null or empty text is stored as one row of zero samples; a file that is no Netpbm or BMP, is cut short,
has no rows or columns, samples over its maximum, an index outside its palette or other bit masks than 8 bits of blue,
green and red decodes to None and gives null features; repeated rows give equal values; columns of the names of the
new ones are replaced, all others stay.
"""

from __future__ import annotations

import functools
import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glossmill.llm import runtime

WIDTH = 64
TILED, TILE = 64, 32
#: The places of red, green and blue in a pixel of 32 bits.
MASKS = (0xFF0000, 0xFF00, 0xFF)
#: Rows of an image past which only the rows that the cells' borders need are held.
LONG = 4096


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(grey: np.ndarray) -> bytes:
    """8-bit grey BMP, rows from the bottom, each padded to four bytes."""
    h, w = grey.shape
    rows = np.zeros((h, (w + 3) // 4 * 4), np.uint8)
    rows[:, :w] = grey[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers of a Netpbm header; # starts a comment up to the line's end. One white space ends the header."""
    out, at = [], 2
    while len(out) < fields:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
            at += 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bitmap = kind in (1, 4)
    numbers, at = _header(data, 2 if bitmap else 3)
    w, h = numbers[:2]
    top = 1 if bitmap else numbers[2]
    if not (w and h and 0 < top < 65536):
        raise ValueError("empty image or maximum")
    planes = 3 if kind in (3, 6) else 1
    if kind == 1:
        digits = np.frombuffer(data, np.uint8, offset=at)
        values = digits[(digits == 48) | (digits == 49)][: w * h] - 48
    elif kind in (2, 3):
        values = np.array(data[at - 1 :].split()[: w * h * planes], np.int64)
        if (values < 0).any():
            raise ValueError("sample under 0")
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        values = np.unpackbits(rows, axis=1)[:, :w]
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * planes, at)
    values = np.asarray(values).reshape((h, w, planes) if planes > 1 else (h, w))
    if bitmap:  # 1 is black
        return ((1 - values) * 255).astype(np.uint8)
    if (values > top).any():
        raise ValueError("sample over the maximum")
    return values if values.dtype == np.uint8 else values.astype(np.uint16 if top > 255 else np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    at, size, w, h, _, bits, packing = struct.unpack_from("<10xIIiiHHI", data)
    if packing not in (0, 3) or bits not in (8, 24, 32) or w <= 0 or not h:
        raise ValueError("packed or empty BMP")
    if packing == 3 and (bits != 32 or struct.unpack_from("<III", data, 54) != MASKS):
        raise ValueError("other bit masks")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (at - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
        rgb = palette[rows][..., 2::-1]
        return rgb[..., 0] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else rgb
    return rows.reshape(abs(h), w, bits // 8)[..., 2::-1]


def decode(data: bytes | None) -> np.ndarray | None:
    """Array of rows and columns, with a third axis of red, green and blue for colour files."""
    try:
        if data and data[:1] == b"P" and data[1:2] in b"123456" and data[2:3].isspace():
            return _netpbm(data)
        if data and data[:2] == b"BM":
            return _bmp(data)
    except (ValueError, IndexError, OverflowError, struct.error):
        pass
    return None


@functools.lru_cache(4096)
def _borders(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(m + 1) * (n / m)
    low = np.minimum(x.astype(np.int64), n - 1)
    return low, x - low


def area_resize(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each output cell: differences of the integral image at fractional borders.

    The last two axes are rows and columns; images may be stacked before them.
    """
    h, w = images.shape[-2:]
    low, part = _borders(h, height)
    if h > LONG:  # the integral image's rows at the borders alone: what lies between two of them is summed at once
        edges = np.unique(np.concatenate((low, low + 1)))
        sums = np.add.reduceat(images, edges[:-1], axis=-2, dtype=np.float64)
        total = np.zeros((*images.shape[:-2], len(edges), w + 1))
        np.cumsum(sums, axis=-2, out=total[..., 1:, 1:])
        upper, lower = np.searchsorted(edges, low), np.searchsorted(edges, low + 1)
    else:
        total = np.zeros((*images.shape[:-2], h + 1, w + 1))
        np.cumsum(images, axis=-2, dtype=np.float64, out=total[..., 1:, 1:])
        upper, lower = low, low + 1
    rows = total[..., upper, :] * (1 - part)[:, None] + total[..., lower, :] * part[:, None]
    np.cumsum(rows, axis=-1, out=rows)
    low, part = _borders(w, width)
    grid = rows[..., low] * (1 - part) + rows[..., low + 1] * part
    cells = grid[..., 1:, 1:] - grid[..., :-1, 1:] - grid[..., 1:, :-1] + grid[..., :-1, :-1]
    return cells * (height * width / (h * w))


def difference_hashes(images: np.ndarray) -> list[str]:
    """64 bits for each of a stack: whether each cell of an 8 by 9 grid is brighter than its left neighbour."""
    grid = np.rint(area_resize(images, 8, 9) * 256)
    bits = np.packbits((grid[..., 1:] > grid[..., :-1]).reshape(len(images), 64), axis=1).tobytes()
    return [bits[i : i + 8].hex() for i in range(0, len(bits), 8)]


@functools.lru_cache(256)
def _npy_head(kind: str, shape: tuple[int, ...]) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": shape})
    return out.getvalue()


def npy(array: np.ndarray) -> bytes:
    return _npy_head(array.dtype.str, array.shape) + array.tobytes()


def tiles(image: np.ndarray, size: int = TILED, tile: int = TILE) -> list[tuple[bytes, str]]:
    """NPY file and difference hash of each tile of the image, resized to size by size."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    small = np.rint(area_resize(grey, size, size)).astype(np.uint16 if image.dtype == np.uint16 else np.uint8)
    k = size // tile
    cut = small.reshape(k, tile, k, tile).swapaxes(1, 2).reshape(k * k, tile, tile)
    return [(npy(c), h) for c, h in zip(cut, difference_hashes(cut), strict=True)]


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    return text + bytes(-len(text) % unit if text else unit)


def encode_text(text: bytes) -> bytes:
    """The file that a text is stored as."""
    payload = payload_of(text)
    return encode_bmp(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)) if zlib.crc32(payload) % 2 else encode_pgm(payload)


def store_text(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column: the text stored as an image file. One pass, no shuffle."""

    def make():
        return lambda texts: [pa.array([encode_text(t) for t in texts], pa.binary())]

    return runtime.append_columns(docs, text, [T.StructField(media, T.BinaryType())], make)


def with_tiles(docs: DataFrame, media: str = "media", tiled: str = "tiles") -> DataFrame:
    """docs with array<struct<npy binary, dhash string>> of the image's tiles; null where it can't be decoded."""
    kind = T.ArrayType(T.StructType([T.StructField("npy", T.BinaryType()), T.StructField("dhash", T.StringType())]))

    def make():
        arrow = pa.list_(pa.struct([("npy", pa.binary()), ("dhash", pa.string())]))

        def step(files: list[bytes]):
            images = (decode(f) for f in files)
            return [pa.array([None if i is None else [{"npy": a, "dhash": b} for a, b in tiles(i)] for i in images], arrow)]

        return step

    return runtime.append_columns(docs, media, [T.StructField(tiled, kind)], make, max_rows=128)


def read_back(docs: DataFrame, media: str = "media") -> DataFrame:
    """docs with the digests and features of the stored files; the payload is what the decoder gives.

    The feature is the tiles' difference hashes; tiles_sha256 is the digest of their NPY files, one after the other.
    """
    long, string = T.LongType(), T.StringType()
    fields = [T.StructField("payload_bytes", long), T.StructField("payload_sha256", string), T.StructField("tail_crc32", long), T.StructField("media_bytes", long), T.StructField("media_sha256", string), T.StructField("feature", string), T.StructField("n_tiles", T.IntegerType()), T.StructField("tiles_sha256", string)]

    def make():
        def step(files: list[bytes]):
            rows = []
            for f in files:
                image = decode(f)
                if image is None:
                    rows.append((None, None, None, len(f), hashlib.sha256(f).hexdigest(), None, None, None))
                    continue
                payload = image.tobytes()
                cut = tiles(image)
                feature, files_ = "-".join(h for _, h in cut), hashlib.sha256(b"".join(n for n, _ in cut)).hexdigest()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(f), hashlib.sha256(f).hexdigest(), feature, len(cut), files_))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
            return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]

        return step

    return runtime.append_columns(docs, media, fields, make)
