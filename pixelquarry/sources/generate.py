"""Generated rasters: constants and lattice noise."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.raster import Raster, RasterError, f32

FREQUENCY_PIXELS = 64.0
LAYOUTS = {"gray": 1, "gray-alpha": 2, "rgb": 3, "rgba": 4}


def mix64(z: np.ndarray) -> np.ndarray:
    # The multipliers of the public splitmix64 finaliser.
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    at = spark.range(width * height)
    return at.select(F.lit(0).cast("long").alias("rid"), F.expr(f"CAST(id DIV {width} AS INT)").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def create(spark: SparkSession, width: int, height: int, layout: str, fill: list[float], color: str = "srgb", range_: str = "display-referred") -> Raster:
    if layout not in LAYOUTS or len(fill) != LAYOUTS[layout]:
        raise RasterError("the fill must have one value for each channel")
    has_alpha = layout.endswith("a") or layout == "gray-alpha"
    for i, v in enumerate(fill):
        alpha = has_alpha and i == len(fill) - 1
        if not math.isfinite(v) or ((range_ == "display-referred" or alpha) and not 0 <= v <= 1):
            raise RasterError("the fill is out of range")
    return Raster(grid(spark, width, height), tuple(f32(F.lit(v)) for v in fill), width, height, color, range=range_, has_alpha=has_alpha)


def lattice(gx: np.ndarray, gy: np.ndarray, seed: int) -> np.ndarray:
    """Values in [-1, 1) at lattice points."""
    # The odd multipliers of the two axes.
    with np.errstate(over="ignore"):
        hx = mix64(np.uint64(seed) ^ gx.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = mix64(hx ^ gy.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (h >> np.uint64(40)).astype(np.float64) / (1 << 24) * 2 - 1


def _noise(frame: DataFrame, name: str, scale: float, width: int, height: int, seed: int) -> DataFrame:
    """``frame`` with a column of value noise: the few lattice points are hashed on the driver and broadcast, the rest is projection."""
    nx, ny = math.floor(width * scale) + 3, math.floor(height * scale) + 3
    gy, gx = np.meshgrid(np.arange(ny), np.arange(nx), indexing="ij")
    points = [(int(x), int(y), float(v)) for x, y, v in zip(gx.ravel(), gy.ravel(), lattice(gx.ravel(), gy.ravel(), seed), strict=True)]
    table = frame.sparkSession.createDataFrame(points, "gx int, gy int, v double")
    px, py = (F.col("x") + 0.5) * scale, (F.col("y") + 0.5) * scale
    frame = frame.withColumns({"gx0": F.floor(px).cast("int"), "gy0": F.floor(py).cast("int")})
    for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
        side = table.select((F.col("gx") - i).alias("gx0"), (F.col("gy") - j).alias("gy0"), F.col("v").alias(f"v{i}{j}"))
        frame = frame.join(F.broadcast(side), ["gx0", "gy0"])  # (width * scale + 3) * (height * scale + 3) rows
    fade = lambda t: t * t * t * (t * (t * 6.0 - 15.0) + 10.0)
    tx, ty = fade(px - F.floor(px)), fade(py - F.floor(py))
    lerp = lambda a, b, t: (b - a) * t + a
    value = lerp(lerp(F.col("v00"), F.col("v10"), tx), lerp(F.col("v01"), F.col("v11"), tx), ty)
    return frame.withColumn(name, value).drop("gx0", "gy0", "v00", "v10", "v01", "v11")


def noise(spark: SparkSession, width: int, height: int, frequency: float = 1.0, seed: int = 0) -> Raster:
    frame = _noise(grid(spark, width, height), "n", frequency / FREQUENCY_PIXELS, width, height, seed)
    return Raster(frame, (f32(F.col("n")),), width, height, "raw-linear")


def fbm(spark: SparkSession, width: int, height: int, frequency: float = 1.0, seed: int = 0, octaves: int = 4, lacunarity: float = 2.0, gain: float = 0.5) -> Raster:
    if not 1 <= octaves <= 32:
        raise RasterError("octaves must be from 1 to 32")
    frame, total, amplitude, scale = grid(spark, width, height), 0.0, 1.0, frequency / FREQUENCY_PIXELS
    value: Column = F.lit(0.0)
    for o in range(octaves):
        own = int(mix64(np.uint64(seed) ^ np.uint64(o + 1)))
        frame = _noise(frame, f"n{o}", scale, width, height, own)
        value = value + F.col(f"n{o}") * amplitude
        total, amplitude, scale = total + amplitude, amplitude * gain, scale * lacunarity
    return Raster(frame, (f32(value / total),), width, height, "raw-linear")
