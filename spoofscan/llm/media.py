"""Media columns: images as bytes, decoded to numpy arrays, resized by area and hashed.

Netpbm (P1 to P6, with comments, up to 16 bits a sample) and uncompressed BMP (8 to 32 bits, bit fields) are decoded; NPY tiles
and binary Netpbm are written. All of it is per-row work in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, small_batches

#: A text's payload is rows of 64 RGB pixels, 8 bits a sample.
ROW_PIXELS = 64
ROW_BYTES = 3 * ROW_PIXELS
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


class BadImage(ValueError):
    pass


def encode_ppm(pixels: np.ndarray) -> bytes:
    """P6 of a (height, width, 3) array, or P5 of a (height, width) one, 8 bits a sample."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _scaled(values: np.ndarray, top: int) -> np.ndarray:
    """Samples of 0 to `top` as uint8 or, if `top` is over 255, as uint16, over that type's whole range."""
    kind, full = (np.uint8, 255) if top < 256 else (np.uint16, 65535)
    if not 0 < top < 65536 or (values.size and not 0 <= values.min() <= values.max() <= top):
        raise BadImage("a sample is out of range")
    return values.astype(kind) if top == full else ((values.astype(np.int64) * full + top // 2) // top).astype(kind)


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise BadImage("not Netpbm")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _TOKEN.match(data, at)):
            raise BadImage("short header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = *head[:2], head[2] if len(head) > 2 else 1
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n = width * height * (len(shape) == 3 and 3 or 1)
    if kind == b"P1":
        values = 1 - np.array([int(x) for x in re.findall(rb"[01]", re.sub(rb"#[^\n]*", b"", data[at:]))[:n]], np.int64)
    elif kind in (b"P2", b"P3"):
        values = np.array([int(x) for x in re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n]], np.int64)
    elif kind == b"P4":  # one white space byte ends the header
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        values = 1 - np.unpackbits(rows, axis=1)[:, :width]
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    return _scaled(values.reshape(shape), top)


def _mask_shift(mask: int) -> int:
    return (mask & -mask).bit_length() - 1 if mask else 0


def _bmp(data: bytes) -> np.ndarray:
    offset, size, width, height, _, bits, packed = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if data[:2] != b"BM" or packed not in (0, 3) or bits not in (8, 16, 24, 32) or (packed == 3 and bits not in (16, 32)):
        raise BadImage("not an uncompressed BMP of 8, 16, 24 or 32 bits")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, : width * bits // 8]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        pixels = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[rows][:, :, 2::-1]
    elif packed == 3 or bits == 16:  # bit fields; without masks, 16 bits are five for each colour
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        values = np.ascontiguousarray(rows).view(f"<u{bits // 8}").astype(np.int64)
        parts = [(values & m) >> _mask_shift(m) for m in masks]
        pixels = np.stack([(x * 255 + (t := m >> _mask_shift(m)) // 2) // max(t, 1) for x, m in zip(parts, masks, strict=True)], axis=2).astype(np.uint8)
    else:
        pixels = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def _read(data: bytes, how) -> np.ndarray:
    try:
        return how(data)
    except (struct.error, ValueError, IndexError, OverflowError, TypeError, MemoryError) as e:
        raise e if isinstance(e, BadImage) else BadImage(str(e)) from e


def decode_netpbm(data: bytes) -> np.ndarray:
    """A (height, width) or (height, width, 3) array of uint8, or uint16 if the file's largest value is over 255.

    Samples are spread over that type's range whatever the largest value (bits to 0 and 255), so that files compare.
    """
    return _read(data, _netpbm)


def decode_bmp(data: bytes) -> np.ndarray:
    """A (height, width, 3) uint8 array, red first, of an uncompressed BMP, bit fields included."""
    return _read(data, _bmp)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The means of `pixels` over a grid of equal areas, fractions of pixels included, by an integral image."""
    pixels = pixels.astype(np.float64)
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1, *pixels.shape[2:]))
    np.cumsum(np.cumsum(pixels, axis=0), axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, axis: int, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(int), table.shape[axis] - 2)
        part = (edges - low).reshape([-1 if i == axis else 1 for i in range(table.ndim)])
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    ys, xs = np.linspace(0, pixels.shape[0], height + 1), np.linspace(0, pixels.shape[1], width + 1)
    corners = at(xs, 1, at(ys, 0, total))
    sums = np.diff(np.diff(corners, axis=0), axis=1)
    return sums / (pixels.shape[0] / height * pixels.shape[1] / width)


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 areas is brighter than the next in its row."""
    small = np.round(area_resize(grey(pixels), 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:]).tobytes(), "big")


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tiles(pixels: np.ndarray, side: int) -> np.ndarray:
    """The image resized to a square uint8 tile."""
    return np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8)


def image_tiles(images: DataFrame, image: str = "image", side: int = 16) -> DataFrame:
    """`images` with _tile (NPY bytes), _hash (16 hex digits), _height, _width, _error.

    A null image gives nulls; bytes that can't be decoded give nulls and the reason in _error. Columns of `images` that
    have one of these names are replaced.
    """
    schema = "_tile binary, _hash string, _height int, _width int, _error string"

    @F.pandas_udf(schema)
    def read(column):
        import pandas as pd

        out = []
        for data in column:
            if data is None:
                out.append((None, None, None, None, None))
                continue
            try:
                x = decode(bytes(data))
                if not x.size:
                    raise BadImage("no pixels")
                if x.dtype != np.uint8:
                    x = x // 257
                out.append((npy(tiles(x, side)), f"{difference_hash(x):016x}", *x.shape[:2], None))
            except BadImage as e:
                out.append((None, None, None, None, str(e)))
        return pd.DataFrame(out, columns=["_tile", "_hash", "_height", "_width", "_error"])

    own = schema.replace(",", "").split()[::2]
    rest = [F.col(f"_row.{c}").alias(c) for c in images.columns if c not in own]
    return images.select(F.struct(*images.columns).alias("_row"), read(F.col(image)).alias("_read")).select(*rest, "_read.*")


def text_image(text: str) -> tuple[int, bytes]:
    """Of a text, its UTF-8 length and a P6 image whose samples are its bytes, filled up with spaces."""
    data = text.encode()
    size = max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES
    return len(data), encode_ppm(np.frombuffer(data.ljust(size, b" "), np.uint8).reshape(-1, ROW_PIXELS, 3))


def _store(side: int):
    def run(batches):
        for batch in small_batches(batches):
            rows = []
            for text in arrow_texts(batch):
                n, media = text_image(text)
                pixels = decode_netpbm(media)
                payload = pixels.tobytes()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), media, f"{difference_hash(pixels):016x}", npy(tiles(pixels, side))))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "feature", "tile"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([batch.column("id"), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["id", *names])

    return run


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text", side: int = 16) -> DataFrame:
    """One row per row of `docs`: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media, feature, tile.

    The text's bytes (null: none), filled up with spaces to whole rows, are the samples of an image of 64 pixels a row;
    the image is encoded, decoded again, and what was read back is described: its digests, its difference hash and an
    NPY tile. Equal texts have equal values.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = f"id {docs.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, feature string, tile binary"
    out = rows.mapInArrow(_store(side), schema)
    return out.withColumnRenamed("id", key)
