"""Image files: listing, grey pixels of PNG files, and named PNG contents.

PNG files of eight bits a sample that aren't interlaced are decoded (grey, RGB, palette,
with or without alpha); others keep their row with null pixels.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S

EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
_MARK = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the header's colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def list_images(spark, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, stem, suffix, length, content) of the image files below a path of any store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = S.suffix(F.col("path"))
    return files.where(kind.isin([f".{e}" for e in extensions])).select("path", S.stem(F.col("path")).alias("stem"), kind.alias("suffix"), "length", "content")


def _chunks(data: bytes):
    at = len(_MARK)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def _lines(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes with each row's prediction added back."""
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)
    for y in range(height):
        kind, line, up, to = rows[y, 0], rows[y, 1:], out[y], out[y + 1]
        if kind == 0:
            to[step:] = line
        elif kind == 1:
            for c in range(step):
                to[step + c :: step] = np.cumsum(line[c::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            to[step:] = line + up[step:]
        elif kind in (3, 4):
            left, above = to.tolist(), up.tolist()
            for x, v in enumerate(line.tolist()):
                a, b, c = left[x], above[x + step], above[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                left[x + step] = (v + guess) & 255
            to[:] = left
        else:
            raise ValueError("unknown prediction")
    return out[1:, step:]


def grey(data: bytes) -> np.ndarray | None:
    """A PNG's pixels in grey by the usual weights; None where it can't be read."""
    if data[: len(_MARK)] != _MARK:
        return None
    try:
        parts = list(_chunks(data))
        width, height, depth, colour, _, _, woven = struct.unpack(">IIBBBBB", parts[0][1])
        if depth != 8 or woven or colour not in _SAMPLES:
            return None
        n = _SAMPLES[colour]
        raw = zlib.decompress(b"".join(body for kind, body in parts if kind == b"IDAT"))
        pixels = _lines(raw, height, width * n, n).reshape(height, width, n)
        if colour == 3:
            pixels = np.frombuffer(next(body for kind, body in parts if kind == b"PLTE"), np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
        if pixels.shape[2] < 3:
            return pixels[:, :, 0]
        return np.floor(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)
    except (zlib.error, struct.error, ValueError, IndexError, StopIteration):
        return None


def png(pixels: np.ndarray) -> bytes:
    """Grey pixels as a PNG file."""
    height, width = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.hstack((np.zeros((height, 1), np.uint8), pixels.astype(np.uint8))).tobytes()
    return _MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decoded(files: DataFrame) -> DataFrame:
    """files with width and grey pixels row by row, as functions.images takes them."""

    @F.pandas_udf("struct<width:int,pixels:array<int>>")
    def read(content: pd.Series) -> pd.DataFrame:
        found = [grey(bytes(c)) if c is not None else None for c in content]
        return pd.DataFrame({"width": pd.array([None if g is None else g.shape[1] for g in found], "Int32"), "pixels": [None if g is None else g.reshape(-1).astype(np.int32) for g in found]})

    return files.withColumn("_i", read("content")).withColumns({"width": F.col("_i.width"), "pixels": F.col("_i.pixels")}).drop("_i")


def image_rows(images: DataFrame, name: str, order: str, clusters: bool = False) -> DataFrame:
    """images (pixels, width) with `file`, <safe name>__NNN.png or __clusterNNN.png in order, and `content`, the PNG.

    Spark has no sink of one file a row, so these rows are what is written.
    """
    safe = S.safe_chars(F.col(name))
    n = F.row_number().over(Window.partitionBy(safe).orderBy(order))
    file = F.concat(safe, F.lit("__cluster" if clusters else "__"), F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(3)), F.lit("0")), F.lit(".png"))

    @F.pandas_udf("binary")
    def write(pixels: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([png(np.asarray(p, np.uint8).reshape(-1, int(w))) if p is not None and w else None for p, w in zip(pixels, width)], dtype=object)

    return images.withColumns({"file": file, "content": write("pixels", "width")})
