"""Neighbourhood filters: kernels over lines and over tiles with halos, and window frames."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.blocks import Grids, tile_places, tiled
from ..plans.raster import KEYS, Raster, RasterError, f32, together
from .geometry import bounded_index, two_passes

SIGMA_CUTOFF = 1e-3


def convolve(image: Raster, width: int, height: int, weights: list[float], origin: tuple[int, int] | None = None, mode: str = "clamp", value: float = 0.0) -> Raster:
    """Correlation with an explicit kernel; ``valid`` shrinks the image, a constant stands in for what lies outside.

    Every output pixel has a row, also where all its taps lie outside or weigh nothing; a weight of 0 ignores its sample.
    """
    ox, oy = (0, 0) if mode == "valid" else origin or (width // 2, height // 2)
    out_w, out_h = (image.width - width + 1, image.height - height + 1) if mode == "valid" else (image.width, image.height)
    if out_w <= 0 or out_h <= 0:
        raise RasterError("the kernel is larger than the image")
    edge = "constant" if mode == "valid" else mode
    xs = tile_places(image.width, out_w, width, ox, lambda i: bounded_index(i, image.width, edge))
    ys = tile_places(image.height, out_h, height, oy, lambda i: bounded_index(i, image.height, edge))
    taps = [(k // width, k % width, float(w)) for k, w in enumerate(weights) if w]

    def kernel(grids: Grids) -> Grids:
        h, w = grids[0].shape[0] - height + 1, grids[0].shape[1] - width + 1
        return [sum((t * g[j : j + h, i : i + w] for j, i, t in taps), np.zeros((h, w))) for g in grids]

    return image.over(tiled(image, xs, ys, (width, height), (out_w, out_h), kernel, value), len(image.channels), width=out_w, height=out_h)


def gaussian_kernel(n: int, sigma: float, mode: str):
    """Lines of ``n`` samples, extended by the boundary mode and summed under the normalised weights."""
    radius = math.ceil(3 * sigma)
    weights = np.exp(-(np.arange(-radius, radius + 1.0) ** 2) / (2 * sigma * sigma))
    weights /= weights.sum()
    source = np.array([n if (i := bounded_index(k, n, mode)) is None else i for k in range(-radius, n + radius)])

    def run(grids: Grids) -> Grids:
        out = []
        for g in grids:
            wide = np.concatenate((g, np.zeros((len(g), 1))), axis=1)[:, source]
            out.append(sum((w * wide[:, k : k + n] for k, w in enumerate(weights)), np.zeros(g.shape)))
        return out

    return run


def gaussian_blur(image: Raster, sigma: float, mode: str = "clamp", sigma_max: float = 512.0) -> Raster:
    """Separable: two one-dimensional passes."""
    if not 0 <= sigma <= sigma_max:
        raise RasterError("sigma is out of range")
    if sigma <= SIGMA_CUTOFF:
        return image
    return two_passes(image, gaussian_kernel(image.width, sigma, mode), gaussian_kernel(image.height, sigma, mode), image.width, image.height)


def bilateral(image: Raster, spatial_sigma: float, range_sigma: float) -> Raster:
    """Each pixel meets the neighbours of its window, weighted by place and by joint channel distance; a tile with its halo at a time."""
    radius = math.ceil(3 * spatial_sigma)
    size, n = 2 * radius + 1, len(image.channels)
    xs = tile_places(image.width, image.width, size, radius, lambda i: bounded_index(i, image.width, "clamp"))
    ys = tile_places(image.height, image.height, size, radius, lambda i: bounded_index(i, image.height, "clamp"))

    def kernel(grids: Grids) -> Grids:
        h, w = grids[0].shape[0] - 2 * radius, grids[0].shape[1] - 2 * radius
        own = [g[radius : radius + h, radius : radius + w] for g in grids]
        sums, total = [np.zeros((h, w)) for _ in grids], np.zeros((h, w))
        for j in range(size):
            for i in range(size):
                near = [g[j : j + h, i : i + w] for g in grids]
                away = sum((c - q) ** 2 for c, q in zip(own, near, strict=True))
                weight = np.exp(-((j - radius) ** 2 + (i - radius) ** 2) / (2 * spatial_sigma**2) - away / (2 * range_sigma**2))
                total += weight
                for s, q in zip(sums, near, strict=True):
                    s += weight * q
        return [s / total for s in sums]

    return image.over(tiled(image, xs, ys, (size, size), (image.width, image.height), kernel), n)


def _box(table, names: list[str], radius: int):
    """Means over the square of ``radius``, shrunk at the edges: a window frame along x and one along y."""
    for fixed, along in (("y", "x"), ("x", "y")):
        frame = Window.partitionBy("rid", fixed).orderBy(along).rangeBetween(-radius, radius)
        table = table.withColumns({n: F.avg(n).over(frame) for n in names})
    return table


def guided(image: Raster, guide: Raster, radius: int, epsilon: float) -> Raster:
    frame, (ps, gs) = together(image, guide)
    gs = gs if len(gs) == len(ps) else gs * len(ps)
    n = len(ps)
    table = frame.select(*KEYS, *[c.cast("double").alias(f"p{i}") for i, c in enumerate(ps)], *[c.cast("double").alias(f"g{i}") for i, c in enumerate(gs)])
    names = {f"{a}{i}": F.col(x) * F.col(y) for i in range(n) for a, x, y in (("gg", f"g{i}", f"g{i}"), ("gp", f"g{i}", f"p{i}"))}
    table = table.withColumns({**names, **{f"m{i}": F.col(f"g{i}") for i in range(n)}, **{f"o{i}": F.col(f"p{i}") for i in range(n)}})
    table = _box(table, [f"{k}{i}" for i in range(n) for k in ("m", "o", "gg", "gp")], radius)
    lines = {}
    for i in range(n):
        spread = F.col(f"gg{i}") - F.col(f"m{i}") * F.col(f"m{i}") + epsilon
        a = F.when(spread <= 0, 0.0).otherwise((F.col(f"gp{i}") - F.col(f"m{i}") * F.col(f"o{i}")) / F.when(spread > 0, spread).otherwise(1.0))
        lines |= {f"a{i}": a, f"b{i}": F.col(f"o{i}") - a * F.col(f"m{i}")}
    table = _box(table.withColumns(lines), list(lines), radius)
    return image.over(table.select(*KEYS, *[f32(F.col(f"a{i}") * F.col(f"g{i}") + F.col(f"b{i}")).alias(f"c{i}") for i in range(n)]), n)


def structure_tensor(image: Raster, gradient_sigma: float = 0.0, integration_sigma: float = 2.0) -> Raster:
    """(Jxx, Jxy, Jyy): products of central differences, summed over the channels and blurred."""
    image = gaussian_blur(image, gradient_sigma)
    n = len(image.channels)
    table = image.table()

    def slope(name: str, along: str, fixed: str) -> Column:
        line = Window.partitionBy("rid", fixed).orderBy(along)
        own = F.col(name)
        return (F.coalesce(F.lead(name).over(line), own).cast("double") - F.coalesce(F.lag(name).over(line), own).cast("double")) / 2

    table = table.withColumns({f"gx{i}": slope(f"c{i}", "x", "y") for i in range(n)} | {f"gy{i}": slope(f"c{i}", "y", "x") for i in range(n)})
    add = lambda a, b: sum((F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in range(n)), F.lit(0.0))
    products = table.select(*KEYS, f32(add("gx", "gx")).alias("c0"), f32(add("gx", "gy")).alias("c1"), f32(add("gy", "gy")).alias("c2"))
    return gaussian_blur(image.over(products, 3, color="raw-linear", has_alpha=False), integration_sigma)
