"""Page images and masks as tables. PNG is read and written with zlib; files come through Spark's binaryFile source."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.geometry import supported_canvas

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
MAX_BYTES = 50 * 1024 * 1024


def image_format(content: Column) -> Column:
    """png or jpeg by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == MAGIC.hex().upper(), "png").when(F.startswith(head, F.lit("FFD8FF")), "jpeg")


def png_size(content: Column) -> tuple[Column, Column]:
    part = lambda k: F.conv(F.hex(F.substring(content, k, 4)), 16, 10).cast("long")
    return part(17), part(21)


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, format, width, height, reason of each file; reason says why it can't be used. Sizes of JPEG files are null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    form = image_format(F.col("content"))
    w, h = (F.when(form == "png", v) for v in png_size(F.col("content")))
    reason = F.when(F.col("length") > MAX_BYTES, "too_large").when(form.isNull(), "format").otherwise(supported_canvas(w, h))
    return files.select("path", F.col("length").alias("bytes"), form.alias("format"), w.alias("width"), h.alias("height"), reason.alias("reason"))


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(MAGIC)
    while at + 8 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += size + 12


def decode_png(data: bytes) -> np.ndarray | None:
    """(height, width, channels) of an 8-bit PNG without interlacing or palette, else None."""
    if data[:8] != MAGIC:
        return None
    head, body = b"", b""
    for kind, content in _chunks(data):
        head = content if kind == b"IHDR" else head
        body += content if kind == b"IDAT" else b""
    if len(head) != 13:
        return None
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in CHANNELS or interlace:
        return None
    n = CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error:
        return None
    if len(raw) != h * (w * n + 1):
        return None
    rows = raw.reshape(h, w * n + 1)
    out = np.zeros((h + 1, (w + 1) * n), np.int64)  # a row above and a pixel to the left of zeros
    for y in range(h):
        line, up, now = rows[y, 1:].astype(np.int64), out[y], out[y + 1]
        match rows[y, 0]:
            case 0:
                now[n:] = line
            case 1:
                now[n:] = np.cumsum(line.reshape(w, n), axis=0).ravel() & 255
            case 2:
                now[n:] = (line + up[n:]) & 255
            case 3:
                for k in range(w * n):
                    now[n + k] = (line[k] + (now[k] + up[n + k]) // 2) & 255
            case 4:
                for k in range(w * n):
                    a, b, c = now[k], up[n + k], up[k]
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    now[n + k] = (line[k] + near) & 255
            case _:
                return None
    return out[1:, n:].reshape(h, w, n).astype(np.uint8)


def encode_png(image: np.ndarray) -> bytes:
    h, w, n = image.shape
    colour = {v: k for k, v in CHANNELS.items()}[n]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, w * n)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def mask_values(image: np.ndarray) -> np.ndarray:
    """A mask's value: grey, the alpha where there is one, else the largest channel."""
    n = image.shape[-1]
    return image[..., 0] if n == 1 else image[..., -1] if n in (2, 4) else image.max(axis=-1)


def pixels(files: DataFrame, content: str = "content", key: str = "path", masks: bool = False) -> DataFrame:
    """(key, x, y, r, g, b, a) or, of masks, (key, x, y, v) of PNG files; a file that can't be read has no rows."""
    columns = ["v"] if masks else ["r", "g", "b", "a"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = decode_png(data or b"")
                if image is None:
                    continue
                h, w, n = image.shape
                if masks:
                    parts = [mask_values(image)]
                else:
                    colour = [image[..., 0]] * 3 if n < 3 else [image[..., k] for k in range(3)]
                    parts = [*colour, image[..., -1] if n in (2, 4) else np.full((h, w), 255, np.uint8)]
                y, x = np.divmod(np.arange(h * w), w)
                arrays = [pa.array([ident] * (h * w), pa.string()), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), *(pa.array(p.ravel().astype(np.int32)) for p in parts)]
                yield pa.RecordBatch.from_arrays(arrays, [key, "x", "y", *columns])

    return files.select(F.col(key).cast("string"), content).mapInArrow(rows, f"{key} string, x int, y int, " + ", ".join(f"{c} int" for c in columns))
