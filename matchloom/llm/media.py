"""Operator 7, media columns: Netpbm and BMP to numpy arrays, integral-image resizing, NPY tiles, difference hashes.

Images live in a binary column. `decode` reads P1 to P6 and uncompressed BMP (8-bit palette, 24 and 32 bits); `resize`
averages areas exactly, fractions of pixels included, by interpolating the integral image at the borders of the new
pixels; `tiles` gives for each image its NPY tile and the 64-bit hash of the differences between neighbours in a row.

The query stores a text's bytes losslessly as 8-bit grey samples of a binary Netpbm image `SIDE` pixels wide, decodes the
stored images, writes their NPY tiles and hashes as a table, and takes its features from the tiles as read back.

Cases: null and empty texts are one block of 255; equal texts have equal values; repeated rows stay; a null or broken
image in `tiles` gives null height, width, tile and hash; an empty table gives no rows; a very long text is one image of
all its bytes, and Arrow batches are handled in slices bounded by rows and bytes; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, slices

UNIT = 576
SIDE = 24
TILE = 32
_HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P5 of a (height, width) or P6 of a (height, width, 3) array of bytes."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP of a (height, width, 3) array of bytes."""
    height, width = pixels.shape[:2]
    rows = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, -1)
    head = np.array([40, width, height], "<i4").tobytes() + np.array([1, 24], "<i2").tobytes() + np.array([0, rows.nbytes, 2835, 2835, 0, 0], "<i4").tobytes()
    return b"BM" + np.array([54 + rows.nbytes, 0, 54], "<i4").tobytes() + head + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) array of bytes. Raises ValueError for what it can't read."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if not re.match(rb"P[1-6]\s", data[:3]):
        raise ValueError("neither Netpbm nor BMP")
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        if not (found := _HEADER.match(data, at)):
            raise ValueError("header")
        numbers.append(int(found[1]))
        at = found.end()
    width, height, most = (*numbers, 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    if kind == 1:
        samples = np.array([int(c) for c in re.findall(rb"[01]", data[at:])], np.int64)
    elif kind in (2, 3):
        samples = np.array(data[at:].split(), np.int64)
    elif kind == 4:
        row = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: row * height]
        samples = np.unpackbits(raw.reshape(-1, row), axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(data, np.uint8 if most < 256 else ">u2", offset=at + 1, count=min(count, (len(data) - at - 1) // (1 if most < 256 else 2)))
    if len(samples) < count:
        raise ValueError("samples missing")
    samples = samples[:count]
    if kind in (1, 4):
        samples = (1 - samples) * 255
    elif most != 255:
        samples = samples.astype(np.int64) * 255 // max(1, most)
    pixels = samples.astype(np.uint8).reshape(height, width, channels)
    return pixels[:, :, 0] if channels == 1 else pixels


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("header")
    start, head = np.frombuffer(data, "<i4", 2, 10).tolist()
    width, height = np.frombuffer(data, "<i4", 2, 18).tolist()
    bits, packed = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if packed or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("kind of BMP")
    row = -(-width * bits // 32) * 4
    if len(data) < start + row * abs(height):
        raise ValueError("samples missing")
    raw = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    if height > 0:
        raw = raw[::-1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        return palette[raw[:, :width]][:, :, 2::-1]
    return raw[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area of every new pixel, as float64, by two interpolated differences of the integral image."""
    grey = pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])

    def borders(table: np.ndarray, cells: int) -> np.ndarray:
        at = np.linspace(0, len(table) - 1, cells + 1)
        low = np.minimum(at.astype(np.int64), len(table) - 2)
        part = (at - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    rows = np.zeros((grey.shape[0] + 1, grey.shape[1]))
    np.cumsum(grey, axis=0, out=rows[1:])
    rows = borders(rows, height)  # sums over the rows above each new border
    both = np.zeros((grey.shape[1] + 1, height + 1))
    np.cumsum(rows.T, axis=0, out=both[1:])
    integral = borders(both, width).T
    area = grey.shape[0] / height * (grey.shape[1] / width)
    return np.diff(np.diff(integral, axis=0), axis=1) / area


def difference_hash(pixels: np.ndarray) -> str:
    small = resize(pixels, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """An NPY file, row by row, of the rounded means; a half rounds up, whatever the noise of floating point."""
    out = io.BytesIO()
    np.save(out, np.floor(resize(pixels, side, side) + 0.5 + 1e-6).astype(np.uint8, order="C"))
    return out.getvalue()


def tiles(images: DataFrame, key: str, media: str, side: int = TILE) -> DataFrame:
    """key, height, width, tile (NPY file), dhash for each row of `images`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    pixels = decode(data or b"")
                    rows.append((pixels.shape[0], pixels.shape[1], npy_tile(pixels, side), difference_hash(pixels)))
                except ValueError:
                    rows.append((None, None, None, None))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[key, "height", "width", "tile", "dhash"])

    chosen = images.select(key, F.col(media).cast("binary"))
    return chosen.mapInArrow(run, f"{key} {chosen.schema[key].dataType.simpleString()}, height int, width int, tile binary, dhash string")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a grey image, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            images = []
            for raw in raws:
                payload = raw + b"\xff" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)
                images.append(encode_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, SIDE)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raws), pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "media"])

    stored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")
    return materialize(stored, "media")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary"


def text_tiles(stored: DataFrame) -> DataFrame:
    """Digests of the payload as decoded from the stored images, their difference hashes and NPY tiles, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for data in batch.column(2).to_pylist():
                pixels = decode(data)
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(pixels), npy_tile(pixels)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return materialize(stored.mapInArrow(run, DIGESTS), "tiles")


def text_features(stored: DataFrame) -> DataFrame:
    """The digests, and `dhash:crc32 of the NPY tile` as feature, from the tiles as read back."""
    crc = F.lpad(F.lower(F.hex(F.crc32("tile"))), 8, "0")
    return text_tiles(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", "dhash", crc).alias("feature"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_features(store_texts(documents(spark, sf_dir)))
