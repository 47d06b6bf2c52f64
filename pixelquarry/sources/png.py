"""PNG files: read through Spark's binary reader, written as rows of a table or as files."""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.raster import Raster, RasterError

MAX_AXIS, MAX_PIXELS, MAX_BYTES = 8192, 67_108_864, 512 << 20
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # fixed values: PNG colour types
_MARK = b"\x89PNG\r\n\x1a\n"


def decode(data: bytes) -> np.ndarray:
    """Samples (height, width, channels) of an 8-bit PNG without interlacing."""
    if data[:8] != _MARK:
        raise RasterError("not a PNG file")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            if max(head[:2]) > MAX_AXIS or head[0] * head[1] > MAX_PIXELS:
                raise RasterError("the image is too large")
            if head[2] != 8 or head[3] not in CHANNELS or head[6]:
                raise RasterError("only 8-bit images without palette or interlacing")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), height * (1 + width * n)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), dtype=np.uint8)
    above = np.zeros(width * n, dtype=np.uint8)
    for y in range(height):
        out[y] = above = _unfilter(rows[y, 0], rows[y, 1:], above, n)
    return out.reshape(height, width, n)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    done = row.astype(int).tolist()
    up = above.tolist()
    for i in range(len(done)):
        left, corner = (done[i - n], up[i - n]) if i >= n else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
        done[i] = (done[i] + guess) & 255
    return np.array(done, dtype=np.uint8)


def encode(samples: np.ndarray) -> bytes:
    height, width, n = samples.shape
    kind = {v: k for k, v in CHANNELS.items()}[n]
    rows = np.concatenate((np.zeros((height, 1), np.uint8), samples.reshape(height, width * n)), axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return _MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_images(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``y``, ``x``, ``ch``, ``v`` of every sample of the PNG files at ``path``; a file is decoded in one task, and one over ``MAX_BYTES`` is an error."""
    files = spark.read.format("binaryFile").load(path)
    small = F.when(F.col("length") <= MAX_BYTES, True).otherwise(F.raise_error(F.concat(F.lit("the file is too large: "), F.col("path"))))
    return decode_table(files.where(small).select("path", "content"))


def decode_table(files: DataFrame) -> DataFrame:
    """The same from a table of ``path`` and ``content``."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                image = decode(bytes(content))
                h, w, n = image.shape
                y, x, ch = np.meshgrid(np.arange(h), np.arange(w), np.arange(n), indexing="ij")
                yield pd.DataFrame({"path": name, "y": y.ravel(), "x": x.ravel(), "ch": ch.ravel(), "v": (image.ravel() / np.float32(255)).astype(np.float32)})

    return files.mapInPandas(run, "path string, y int, x int, ch int, v float")


def quantized(c: Column) -> Column:
    """The byte of a sample: clamped, rounded half up, and 0 for NaN."""
    v = c.cast("float").cast("double")
    return F.when(F.isnan(v), 0).otherwise(F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5)).cast("int")


def encode_images(image: Raster) -> DataFrame:
    """``rid`` and the PNG file of each raster, as rows: written as a table, Spark's commit is the atomic rename."""
    n, w, h = len(image.channels), image.width, image.height
    table = image.frame.select("rid", "y", "x", *[quantized(c).alias(f"c{i}") for i, c in enumerate(image.channels)])

    def run(block: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((h, w, n), dtype=np.uint8)
        out[block["y"], block["x"]] = block[[f"c{i}" for i in range(n)]].to_numpy()
        return pd.DataFrame({"rid": [block["rid"].iloc[0]], "png": [encode(out)]})

    return table.groupBy("rid").applyInPandas(run, "rid long, png binary")


def write_images(image: Raster, folder: str) -> int:
    """A file ``<rid>.png`` of each raster in ``folder``, which all executors must share; returns how many.

    Each file is written under another name, synced, and renamed in one step: readers see whole files only, and a task that
    runs twice puts the same bytes in place again.
    """

    def run(batches):
        for batch in batches:
            for rid, data in zip(batch["rid"], batch["png"], strict=True):
                part = os.path.join(folder, f".{rid}.{uuid.uuid4().hex}.part")
                with open(part, "xb") as out:
                    out.write(data)
                    out.flush()
                    os.fsync(out.fileno())
                os.replace(part, os.path.join(folder, f"{rid}.png"))
            yield pd.DataFrame({"rid": batch["rid"]})

    if not os.path.isdir(folder):
        raise RasterError(f"no folder {folder}")
    return encode_images(image).mapInPandas(run, "rid long").count()
