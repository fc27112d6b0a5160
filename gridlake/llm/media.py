"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from gridlake.llm.shared import cut, map_batches, texts_of

WIDTH = 64
#: Rows of an image that are summed at once.
STRIP = 4096


def encode_pgm(image: np.ndarray) -> bytes:
    """8-bit grey (P5) or RGB (P6) samples as binary Netpbm."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, dtype=np.uint8).tobytes()


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Whitespace-separated numbers after the magic, comments skipped; and where the samples begin."""
    out, at = [], 2
    while len(out) < fields:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, with samples of 8 or 16 bits; grey images have two axes, RGB three."""
    magic = data[:2]
    if magic not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap, rgb = magic in (b"P1", b"P4"), magic in (b"P3", b"P6")
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    top = 1 if bitmap else numbers[2]
    shape = (height, width, 3) if rgb else (height, width)
    need = int(np.prod(shape, dtype=np.int64))
    if magic == b"P1":
        flat = np.array([c - 48 for c in data[at - 1 :] if c in b"01"][:need], np.uint8)
        return ((1 - flat) * 255).reshape(shape)
    if magic in (b"P2", b"P3"):
        flat = np.array(data[at - 1 :].split()[:need], np.int64)
    elif magic == b"P4":
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, need, at)
    image = flat.reshape(shape)
    return image.astype(np.uint8 if top < 256 else np.uint16)


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit (RGB) or 8-bit grey palette BMP, bottom row first."""
    height, width = image.shape[:2]
    grey = image.ndim == 2
    rows = image if grey else image[:, :, ::-1]
    flat = np.ascontiguousarray(rows[::-1], np.uint8).reshape(height, -1)
    padded = np.pad(flat, ((0, 0), (0, -flat.shape[1] % 4)))
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + padded.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, padded.size, 2835, 2835, 256 if grey else 0, 0) + palette + padded.tobytes()


def _channels(values: np.ndarray, masks: tuple[int, ...]) -> np.ndarray:
    """The masked parts of whole pixels, each scaled to 8 bits."""
    out = []
    for mask in masks:
        if not mask:
            raise ValueError("BMP without a colour mask")
        shift = (mask & -mask).bit_length() - 1
        out.append((values & mask) >> shift) if mask >> shift == 255 else out.append(((values & mask) >> shift) * 255 // (mask >> shift))
    return np.stack(out, axis=2).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP with 1, 4 or 8 bits and a palette, or 16, 24 or 32 bits, also by the masks that it states; RGB,
    or grey if the palette is grey."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, size = struct.unpack_from("<II", data, 10)
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or (packing == 3 and bits not in (16, 32)):
        raise ValueError("compressed BMP")
    colours = struct.unpack_from("<I", data, 46)[0] or (1 << bits if bits <= 8 else 0)
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    if height > 0:
        rows = rows[::-1]
    if packing == 3 or bits == 16:
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x03E0, 0x001F)
        return _channels(np.ascontiguousarray(rows[:, : width * bits // 8]).view("<u4" if bits == 32 else "<u2").astype(np.uint64), masks)
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1])
    if bits < 8:
        split = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)
        rows = (split * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
    grey = bool((palette == palette[:, :1]).all())
    image = palette[rows[:, :width]]
    return np.ascontiguousarray(image[:, :, 0] if grey else image)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each edge between so many parts of n pixels, the pixel that it is in and how far into it."""
    edge = np.linspace(0, n, parts + 1)
    low = np.minimum(np.floor(edge).astype(np.int64), n - 1)
    return low, edge - low


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area (fractions of pixels too), from the integral image.

    Only the integral's rows at the cells' edges are kept; the others are summed strip by strip, so that a large image
    needs little more memory than its own.
    """
    h, w = image.shape[:2]
    (y, fy), (x, fx) = _edges(h, height), _edges(w, width)
    needed = np.unique(np.concatenate([y, y + 1]))
    total, above = np.zeros((len(needed), w + 1)), np.zeros(w)
    for a in range(0, h, STRIP):
        strip = image[a : a + STRIP].astype(np.float64)
        sums = above + (strip if image.ndim == 2 else strip.mean(axis=2)).cumsum(axis=0)
        here = (needed > a) & (needed <= a + len(sums))
        total[here, 1:] = sums[needed[here] - a - 1].cumsum(axis=1)
        above = sums[-1]
    upper, lower = np.searchsorted(needed, y), np.searchsorted(needed, y + 1)
    rows = total[upper] * (1 - fy)[:, None] + total[lower] * fy[:, None]
    cells = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return (cells[1:, 1:] - cells[:-1, 1:] - cells[1:, :-1] + cells[:-1, :-1]) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells is darker than its right neighbour; 16 hex digits."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, height: int = 16, width: int = 16) -> bytes:
    """The area-resized image as an NPY file of 8-bit samples, row by row."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.clip(np.round(area_resize(image, height, width)), 0, 255), dtype=np.uint8))
    return out.getvalue()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the UTF-8 bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as the samples of a 64 pixels wide PGM image.  Null counts as empty."""

    def make():
        def step(batch):
            pairs = [payload_of(t) for t in texts_of(batch)]
            return {"doc_id": batch.column(0), "n_bytes": [n for n, _ in pairs], "media": [encode_pgm(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for _, p in pairs]}

        return step

    return map_batches(docs, ["doc_id", "text"], "doc_id long, n_bytes long, media binary", make)


def media_features(stored: DataFrame) -> DataFrame:
    """Decode a media column (Netpbm or BMP): samples' digests, difference hash and an NPY tile for each row."""

    def make():
        def step(batch):
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")}
            for media in batch.column(2).to_pylist():
                image = decode(media)
                samples = image.tobytes()
                tile = npy_tile(image)
                row = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"dhash:{difference_hash(image)};tile:{hashlib.sha256(tile).hexdigest()[:16]}", tile)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            return {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | out

        return step

    return map_batches(stored, ["doc_id", "n_bytes", "media"], "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary", make)


def media_columns(docs: DataFrame) -> DataFrame:
    """Write the media column to a table in the shared folder, read it back and compute features of what was read; these,
    with the NPY tiles, are a second table beside it.

    One row per row of ``docs``, repeated ones too; equal texts have equal values.  Null text counts as empty, which is
    64 zero bytes; other columns are not read; an empty table gives no rows.  Row-local: nothing is shuffled.  A text is
    stored whole, in memory of a few times its length.
    """
    return cut(media_features(cut(store_texts(docs), "media")), "tiles")
