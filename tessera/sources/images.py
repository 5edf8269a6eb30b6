"""Image sources and sinks: folders through Spark's own source, bytes of four formats, raw pixels, label lists."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import ENCODED, IMAGE
from tessera.sources.gif import gif, ungif
from tessera.sources.jpeg import jpeg, unjpeg


def read_images(spark: SparkSession, *paths: str, drop_invalid: bool = True, limit: int | None = None) -> DataFrame:
    """Image: the pictures of folders or globs, decoded in the JVM; several paths are one table, of limit rows at most."""
    found = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(list(paths))
    found = found.select(F.col("image").alias("Image"))
    return found if limit is None else found.limit(limit)


def read_labels(spark: SparkSession, path: str) -> list[str]:
    """The lines of a label file, in order; a few thousand at most."""
    return [r.value for r in spark.read.text(path, wholetext=False).collect()]


def from_pixels(width: Column, height: Column, data: Column, origin: str = "") -> Column:
    """An image struct of BGRA bytes."""
    return F.struct(F.lit(origin).alias("origin"), height.cast("int").alias("height"), width.cast("int").alias("width"),
                    F.lit(4).alias("nChannels"), F.lit(24).alias("mode"), data.alias("data"))


def png(rgb: np.ndarray) -> bytes:
    """(H, W, 3 or 4) bytes as a PNG file."""
    h, w, channels = rgb.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb).reshape(h, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 6 if channels == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def bmp(rgb: np.ndarray) -> bytes:
    """(H, W, 3 or 4) bytes as a BMP file of 24 bits a pixel; alpha is left out."""
    h, w = rgb.shape[:2]
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = rgb[::-1, :, 2::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def unbmp(data: bytes) -> np.ndarray:
    """(H, W, 3) bytes of an uncompressed BMP file of 24 or 32 bits a pixel."""
    start, _, w, h, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed not in (0, 3) or w < 1 or h == 0:
        raise ValueError("only uncompressed BMP files of 24 or 32 bits")
    width = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * width, start).reshape(abs(h), width)[:, : w * bits // 8]
    rgb = rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return rgb[::-1] if h > 0 else rgb


def _unfiltered(lines: np.ndarray, size: int) -> np.ndarray:
    """Lines of (filter, bytes) as bytes; size is the number of bytes of a pixel.

    A byte needs its left, upper and upper left neighbours, so that the pixels of one diagonal can be done at once.
    """
    h, w = lines.shape[0], (lines.shape[1] - 1) // size
    kind, raw = lines[:, 0], lines[:, 1:].reshape(h, w, size).astype(np.int16)
    if kind.max(initial=0) > 4:
        raise ValueError("no such filter")
    if not kind.any():
        return raw.astype(np.uint8)
    out = np.zeros((h + 1, w + 1, size), np.int16)  # one line and one column of zeros before the first
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x, k = d - y, kind[y][:, None]
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = np.select([k == 1, k == 2, k == 3, k == 4], [a, b, (a + b) // 2, paeth], 0)
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def unpng(data: bytes) -> np.ndarray:
    """(H, W, C) bytes of a PNG file without interlacing: grey, RGB (palettes too) or either with alpha; of 16 bits
    the upper 8 are taken, and fewer than 8 are stretched."""
    if not data:
        raise ValueError("no bytes to decode")
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, parts = 8, {b"IHDR": b"", b"IDAT": b"", b"PLTE": b""}
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind in parts:
            parts[kind] += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if channels is None or interlace or w < 1 or h < 1:
        raise ValueError("only PNG files without interlacing")
    line = (w * channels * depth + 7) // 8
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8)[: h * (1 + line)].reshape(h, 1 + line)
    out = _unfiltered(lines, max(1, channels * depth // 8)).reshape(h, line)
    if depth < 8:
        bits = np.unpackbits(out, axis=1)[:, : w * depth].reshape(h, w, depth)
        out = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)
        out = out if color == 3 else out * np.uint8(255 // ((1 << depth) - 1))
    out = (out.reshape(h, -1)[:, ::2] if depth == 16 else out).reshape(h, w, channels)
    if color == 3:
        return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[out[:, :, 0]]
    return out if channels != 2 else out[:, :, [0, 0, 0, 1]]


def encode(image: str | Column, media_type: str = "image/png", quality: int = 90) -> Column:
    """struct(data, media_type): an image struct as a file. JPEG (of a quality of 1 to 100), GIF and BMP are written
    where they are asked for, else PNG."""
    if not 1 <= quality <= 100:
        raise ValueError("a quality is a number of 1 to 100")
    asked = media_type.lower()
    kinds = {"image/bmp": bmp, "image/gif": gif, "image/jpeg": lambda p: jpeg(p, quality)}
    kind = "image/jpeg" if asked == "image/jpg" else asked if asked in kinds else "image/png"
    write = kinds.get(kind, png)

    def udf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if not r["data"]:
                    rows.append({"data": None, "media_type": None})
                    continue
                p = np.frombuffer(r["data"], np.uint8).reshape(int(r["height"]), int(r["width"]), -1)
                p = p[:, :, [2, 1, 0, 3]] if p.shape[2] == 4 else p[:, :, ::-1] if p.shape[2] == 3 else np.repeat(p, 3, axis=2)
                rows.append({"data": write(p), "media_type": kind})
            yield pd.DataFrame(rows)

    return F.pandas_udf(udf, ENCODED)(image)


READERS = {b"BM": unbmp, b"\xff\xd8": unjpeg, b"GIF8": ungif}


def pixels_of(data: bytes) -> np.ndarray | None:
    """The pixels of a PNG, JPEG, GIF or BMP file, null for bytes that can't be decoded."""
    try:
        return next((read for head, read in READERS.items() if data.startswith(head)), unpng)(data)
    except (ValueError, IndexError, KeyError, TypeError, struct.error, zlib.error):
        return None


def decode(data: str | Column) -> Column:
    """An image struct of the bytes of a PNG, JPEG, GIF or BMP file; null for a null and for what can't be decoded."""

    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for b in s:
                p = None if b is None else pixels_of(bytes(b))
                if p is None:
                    rows.append(dict.fromkeys(("origin", "height", "width", "nChannels", "mode", "data")))
                    continue
                c = p.shape[2]
                q = p if c == 1 else p[:, :, ::-1] if c == 3 else p[:, :, [2, 1, 0, 3]]
                rows.append({"origin": "", "height": p.shape[0], "width": p.shape[1], "nChannels": c,
                             "mode": {1: 0, 3: 16, 4: 24}[c], "data": np.ascontiguousarray(q).tobytes()})
            yield pd.DataFrame(rows)

    return F.pandas_udf(udf, IMAGE)(data)
