"""Images as numpy arrays: Netpbm and BMP in, NPY tiles and difference hashes out.

``media_tiles`` decodes a binary column, resizes by area through integral
images and returns each picture's size, tile (NPY bytes) and 64-bit difference
hash. ``payload_media`` stores texts as pictures (Netpbm pixmaps, or BMP where
the payload's checksum is odd), reads them back, and gives the tile and hash of
what it read. Integral images are summed in strips of STRIP rows, so that a
picture needs little more memory than its samples.

Defined results: null or undecodable content gives nulls (with the reason in
``problem``); a null text is the empty one; rows that repeat, and equal
contents, get equal values; an empty table gives no rows; further columns are
ignored except the id.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TILE = 32
UNIT = 192
ROW_PIXELS = 64
STRIP = 1024


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P6 of an (h, w, 3) or P5 of an (h, w) array of 8-bit samples."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (h, w) or (h, w, 3), 8-bit, or 16-bit where the largest value needs it."""
    kind, at = data[:2], 2

    def number() -> int:
        nonlocal at
        while True:
            while at < len(data) and data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] != b"#":
                break
            at = (data.find(b"\n", at) + 1) or len(data)
        begin = at
        while data[at : at + 1].isdigit():
            at += 1
        return int(data[begin:at])

    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    width, height = number(), number()
    largest = 1 if kind in (b"P1", b"P4") else number()
    if not 0 < largest < 65536 or width < 1 or height < 1:
        raise ValueError("bad Netpbm header")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind == b"P4":
        packed = np.frombuffer(data, np.uint8, height * (-(-width // 8)), at + 1)
        out = 255 * (1 - np.unpackbits(packed.reshape(height, -1), axis=1)[:, :width])
    elif kind == b"P1":
        bits = [c - 48 for line in data[at:].splitlines() for c in line.split(b"#")[0] if c in b"01"][:n]
        out = 255 * (1 - np.array(bits, np.int64))
    elif kind in (b"P2", b"P3"):
        out = np.array(b" ".join(line.split(b"#")[0] for line in data[at:].splitlines()).split()[:n], np.int64)
    else:
        out = np.frombuffer(data, np.uint8 if largest < 256 else ">u2", n, at + 1)
    if out.size != n:
        raise ValueError("Netpbm data end early")
    return out.astype(np.uint8 if largest < 256 else np.uint16).reshape((height, width, 3) if channels == 3 else (height, width))


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP of an (h, w, 3) array."""
    height, width, _ = pixels.shape
    pad = -3 * width % 4
    rows = np.zeros((height, 3 * width + pad), np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, -1)
    head = np.array([40, width, height, 1 | 24 << 16, 0, rows.size, 2835, 2835, 0, 0], "<u4").tobytes()
    return b"BM" + np.array([54 + rows.size, 0, 54], "<u4").tobytes() + head + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel as (h, w, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    begin, head = (int(x) for x in np.frombuffer(data, "<u4", 2, 10))
    width, height = (int(x) for x in np.frombuffer(data, "<i4", 2, 18))
    bits, compression = int(np.frombuffer(data, "<u2", 1, 28)[0]), int(np.frombuffer(data, "<u4", 1, 30)[0])
    if compression or bits not in (1, 4, 8, 24, 32) or width < 1 or not height:
        raise ValueError("unsupported BMP")
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), begin).reshape(abs(height), stride)
    if height > 0:
        rows = rows[::-1]
    if bits >= 24:
        return rows[:, : width * bits // 8].reshape(len(rows), width, bits // 8)[:, :, 2::-1].copy()
    colours = int(np.frombuffer(data, "<u4", 1, 46)[0]) or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
    index = rows if bits == 8 else np.packbits(np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits), axis=2).reshape(len(rows), -1) >> (8 - bits)
    return palette[index[:, :width]]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def integral_rows(pixels: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows of the vertical integral image at fractional edges, summed strip by strip."""
    low = np.minimum(edges.astype(np.int64), len(pixels) - 1)
    share = (edges - low).reshape(-1, *[1] * (pixels.ndim - 1))
    out, above = np.zeros((len(edges), *pixels.shape[1:])), np.zeros((1, *pixels.shape[1:]))
    for at in range(0, len(pixels), STRIP):
        strip = pixels[at : at + STRIP].astype(np.float64)
        sums = np.concatenate([above, above + strip.cumsum(axis=0)])
        here = (low >= at) & (low < at + len(strip))
        out[here] = sums[low[here] - at] * (1 - share[here]) + sums[low[here] - at + 1] * share[here]
        above = sums[-1:]
    return out


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, exact for fractional edges: differences of the interpolated integral image."""
    rows = np.diff(integral_rows(pixels, np.arange(height + 1) * (pixels.shape[0] / height)), axis=0)
    columns = np.diff(integral_rows(np.moveaxis(rows, 1, 0), np.arange(width + 1) * (pixels.shape[1] / width)), axis=0)
    return np.moveaxis(columns, 0, 1) / ((pixels.shape[0] / height) * (pixels.shape[1] / width))


def difference_hash(pixels: np.ndarray) -> str:
    """16 hex digits: where a cell of the 8 x 9 grey reduction is darker than its right neighbour."""
    small = area_resize(pixels, 8, 9)
    small = small.mean(axis=2) if small.ndim == 3 else small
    # Exact ties must not depend on rounding.
    return np.packbits(np.round(np.diff(small, axis=1), 6) > 0).tobytes().hex()


def npy_tile(pixels: np.ndarray, tile: int = TILE) -> bytes:
    """The picture reduced to tile x tile, as an NPY file of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, tile, tile)), 0, 255 if pixels.dtype == np.uint8 else 65535).astype(pixels.dtype), allow_pickle=False)
    return out.getvalue()


def media_tiles(df: DataFrame, media_id: str, content: str, tile: int = TILE) -> DataFrame:
    """media_id, height, width, tile (NPY bytes), difference_hash and problem for a binary column of pictures."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[media_id]

    def one(data: bytes | None) -> tuple:
        try:
            pixels = decode(data or b"")
            return pixels.shape[0], pixels.shape[1], npy_tile(pixels, tile), difference_hash(pixels), None
        except (ValueError, IndexError) as e:
            return None, None, None, None, str(e)[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["media_id", "height", "width", "tile", "difference_hash", "problem"])

    return df.select(F.col(media_id).alias("media_id"), F.col(content).alias("content")).mapInArrow(run, f"media_id {kind}, height int, width int, tile binary, difference_hash string, problem string")


def to_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of UNIT, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT), len(raw)


def store_payload(payload: bytes) -> bytes:
    """The payload as the samples of a picture ROW_PIXELS wide, whose rows need no padding in either format."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW_PIXELS, 3)
    return encode_bmp(pixels) if zlib.crc32(payload) & 1 else encode_netpbm(pixels)


def payload_media(df: DataFrame, doc_id: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Every text stored as a picture and read back: sizes, digests, the difference hash with the tile's digest, and the files if asked for."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[doc_id]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media", "tile"] * with_media
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]

    def one(text: str | None) -> tuple:
        payload, size = to_payload(text)
        stored = store_payload(payload)
        pixels = decode(stored)
        back, tile = pixels.tobytes(), npy_tile(pixels)
        feature = f"{difference_hash(pixels)}:{hashlib.sha256(tile).hexdigest()[:16]}"
        return (size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, stored, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t)[: len(names) - 1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate(kinds[: len(names) - 1]))], names)

    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary, tile binary" * with_media
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
