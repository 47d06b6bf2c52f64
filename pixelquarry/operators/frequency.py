"""Pyramids by line kernels; spectra by a block kernel for each raster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.raster import KEYS, Raster, RasterError, f32, settle
from .filters import gaussian_blur

MAX_LEVELS = 64


def child(n: int, phase: str) -> int:
    return max(1, n // 2 if phase == "floor" else -(-n // 2))


def gaussian_pyramid(image: Raster, levels: int, sigma: float = 1.0, phase: str = "floor") -> list[Raster]:
    """Finest first; each further level is the blurred one before at its even places, settled once so that coarser ones and the bands read it."""
    if not 1 <= levels <= MAX_LEVELS:
        raise RasterError("levels are out of range")
    out = [image.settled()]
    for _ in range(levels - 1):
        last = out[-1]
        w, h = child(last.width, phase), child(last.height, phase)
        table = gaussian_blur(last, sigma).table().where((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0) & (F.col("x") < 2 * w) & (F.col("y") < 2 * h))
        halved = table.withColumns({"x": F.expr("CAST(x DIV 2 AS INT)"), "y": F.expr("CAST(y DIV 2 AS INT)")})
        out.append(last.over(settle(halved), len(last.channels), width=w, height=h))
    return out


def _up(fine: Raster, coarse: Raster, combine) -> Raster:
    """The fine level with the coarse one, repeated to its extent, by an equi-join on halved coordinates."""
    n = len(fine.channels)
    half = lambda a, size: F.least(F.expr(f"CAST({a} DIV 2 AS INT)"), F.lit(size - 1))
    side = coarse.table().select("rid", F.col("y").alias("hy"), F.col("x").alias("hx"), *[F.col(f"c{i}").alias(f"u{i}") for i in range(n)])
    table = fine.table().withColumns({"hy": half("y", coarse.height), "hx": half("x", coarse.width)}).join(side, ["rid", "hy", "hx"])
    return fine.over(table.select(*KEYS, *[f32(combine(F.col(f"c{i}"), F.col(f"u{i}"))).alias(f"c{i}") for i in range(n)]), n)


def laplacian_split(image: Raster, levels: int, sigma: float = 1.0, phase: str = "floor") -> list[Raster]:
    gauss = gaussian_pyramid(image, levels, sigma, phase)
    return [_up(a, b, lambda p, q: p - q) for a, b in zip(gauss, gauss[1:], strict=False)] + gauss[-1:]


def recombine(bands: list[Raster]) -> Raster:
    out = bands[-1]
    for band in reversed(bands[:-1]):
        out = _up(band, out, lambda p, q: p + q)
    return out


def levels_table(levels: list[Raster]) -> DataFrame:
    """All levels as one table with a ``level`` column."""
    tables = [r.table().select(F.lit(i).alias("level"), "*") for i, r in enumerate(levels)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def fft2(image: Raster) -> DataFrame:
    """``rid``, ``ky``, ``kx`` and ``re_i``, ``im_i`` of each channel: the unnormalised forward transform, one raster a task."""
    n, w, h = len(image.channels), image.width, image.height

    def transform(block: pd.DataFrame) -> pd.DataFrame:
        out = {"rid": np.full(w * h, block["rid"].iloc[0]), "ky": np.repeat(np.arange(h), w), "kx": np.tile(np.arange(w), h)}
        at = block["y"].to_numpy() * w + block["x"].to_numpy()
        for i in range(n):
            grid = np.zeros(w * h)
            grid[at] = block[f"c{i}"].to_numpy()
            spectrum = np.fft.fft2(grid.reshape(h, w)).ravel()
            out |= {f"re_{i}": spectrum.real.astype(np.float32), f"im_{i}": spectrum.imag.astype(np.float32)}
        return pd.DataFrame(out)

    return image.table().groupBy("rid").applyInPandas(transform, "rid long, ky int, kx int, " + ", ".join(f"re_{i} float, im_{i} float" for i in range(n)))


def ifft2(spectrum: DataFrame, like: Raster) -> Raster:
    """Scaled by the number of pixels; the imaginary part is dropped."""
    n, w, h = len(like.channels), like.width, like.height

    def transform(block: pd.DataFrame) -> pd.DataFrame:
        out = {"rid": np.full(w * h, block["rid"].iloc[0]), "y": np.repeat(np.arange(h), w), "x": np.tile(np.arange(w), h)}
        at = block["ky"].to_numpy() * w + block["kx"].to_numpy()
        for i in range(n):
            grid = np.zeros(w * h, dtype=complex)
            grid[at] = block[f"re_{i}"].to_numpy().astype(float) + 1j * block[f"im_{i}"].to_numpy()
            out[f"c{i}"] = np.fft.ifft2(grid.reshape(h, w)).real.ravel().astype(np.float32)
        return pd.DataFrame(out)

    table = spectrum.groupBy("rid").applyInPandas(transform, "rid long, y int, x int, " + ", ".join(f"c{i} float" for i in range(n)))
    return like.over(table, n)


def response(width: int, height: int, low: float, high: float, window: str, mode: str) -> Column:
    """The filter's value at (kx, ky), by radial frequency in cycles a pixel."""

    def signed(k: str, size: int) -> Column:
        return F.when(2 * F.col(k) <= size, F.col(k)).otherwise(F.col(k) - size) / float(size)

    fx, fy = signed("kx", width), signed("ky", height)
    f = F.sqrt(fx * fx + fy * fy)
    if window == "ideal":
        r = F.when((f >= low) & (f <= high), 1.0).otherwise(0.0)
    else:
        middle, half = (low + high) / 2, max((high - low) / 2, 1e-12)
        z = (f - middle) / half
        r = F.exp(-0.5 * z * z)
    return r if mode == "band-pass" else 1.0 - r


def bandpass(image: Raster, low: float, high: float, window: str = "ideal", mode: str = "band-pass") -> Raster:
    spectrum = fft2(image)
    r = response(image.width, image.height, low, high, window, mode)
    parts = [f32(F.col(c).cast("double") * r).alias(c) for c in spectrum.columns[3:]]
    return ifft2(spectrum.select("rid", "ky", "kx", *parts), image)
