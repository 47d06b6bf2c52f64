"""Coordinate remaps: projections where the map is one-to-one, line kernels and joins by place where it is not."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.blocks import Grids, along
from ..plans.raster import KEYS, Raster, RasterError, f32


def crop(image: Raster, x0: int, y0: int, x1: int, y1: int) -> Raster:
    if not (0 <= x0 <= x1 <= image.width and 0 <= y0 <= y1 <= image.height):
        raise RasterError("the rectangle leaves the image")
    inside = image.table().where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    frame = inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
    return image.over(frame, len(image.channels), width=x1 - x0, height=y1 - y0)


def _moved(image: Raster, x: Column, y: Column, width: int, height: int) -> Raster:
    return image.over(image.table().withColumns({"x": x.cast("int"), "y": y.cast("int")}), len(image.channels), width=width, height=height)


def flip(image: Raster, axis: str) -> Raster:
    if axis not in ("horizontal", "vertical", "both"):
        raise RasterError(f"no axis {axis}")
    x, y = F.col("x"), F.col("y")
    return _moved(image, image.width - 1 - x if axis != "vertical" else x, image.height - 1 - y if axis != "horizontal" else y, image.width, image.height)


def rotate90(image: Raster, turns: int) -> Raster:
    """Clockwise quarter turns."""
    x, y, w, h = F.col("x"), F.col("y"), image.width, image.height
    to = {0: (x, y, w, h), 1: (h - 1 - y, x, h, w), 2: (w - 1 - x, h - 1 - y, w, h), 3: (y, w - 1 - x, h, w)}[turns % 4]
    return _moved(image, *to)


def bounded(i: Column, n: int, mode: str) -> Column:
    """The source index of ``i`` on an axis of ``n`` samples; null where a constant stands."""
    if mode in ("constant", "transparent"):
        return F.when((i >= 0) & (i < n), i)
    if mode == "clamp":
        return F.greatest(F.lit(0), F.least(i, F.lit(n - 1)))
    if mode == "wrap":
        return F.pmod(i, F.lit(n))
    if mode == "mirror":  # whole-sample: the edge isn't repeated
        p = F.pmod(i, F.lit(max(1, 2 * (n - 1))))
        return F.least(p, F.lit(2 * (n - 1)) - p) if n > 1 else F.lit(0)
    raise RasterError(f"no boundary mode {mode}")


def bounded_index(i: int, n: int, mode: str) -> int | None:
    """The same on the driver, for taps and tiles."""
    if mode in ("constant", "transparent"):
        return i if 0 <= i < n else None
    if mode == "clamp":
        return min(max(i, 0), n - 1)
    if mode == "wrap":
        return i % n
    if mode == "mirror":
        p = i % max(1, 2 * (n - 1))
        return min(p, 2 * (n - 1) - p) if n > 1 else 0
    raise RasterError(f"no boundary mode {mode}")


def pad(image: Raster, left: int = 0, right: int = 0, top: int = 0, bottom: int = 0, mode: str = "constant", value: float = 0.0) -> Raster:
    """Margins; negative ones crop. Each output index is a row of a small table a source index may be asked for by several."""
    width, height = image.width + left + right, image.height + top + bottom
    if width <= 0 or height <= 0:
        raise RasterError("the margins remove the image")
    spark = image.frame.sparkSession
    rids = image.frame.select("rid").distinct()
    xs = spark.range(width).select(F.col("id").cast("int").alias("x"), bounded(F.col("id").cast("int") - left, image.width, mode).alias("sx"))
    ys = spark.range(height).select(F.col("id").cast("int").alias("y"), bounded(F.col("id").cast("int") - top, image.height, mode).alias("sy"))
    n = len(image.channels)
    source = image.table().withColumnsRenamed({"x": "sx", "y": "sy"})
    if mode in ("constant", "transparent"):
        cells = rids.select("rid", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("i"))
        grid = cells.select("rid", (F.col("i") % width).cast("int").alias("x"), F.expr(f"CAST(i DIV {width} AS INT)").alias("y"))
        grid = grid.withColumns({"sx": bounded(F.col("x") - left, image.width, mode), "sy": bounded(F.col("y") - top, image.height, mode)})
        frame = grid.join(source, ["rid", "sx", "sy"], "left").select(*KEYS, *[F.coalesce(f"c{i}", f32(F.lit(value))).alias(f"c{i}") for i in range(n)])
    else:
        frame = source.join(F.broadcast(xs), "sx").join(F.broadcast(ys), "sy").select(*KEYS, *[f"c{i}" for i in range(n)])  # width and height rows
    return image.over(frame, n, width=width, height=height)


Taps = list[tuple[int, int, float]]


def tap_kernel(taps: Taps, n_out: int):
    """Weighted sums of a line's samples; an output has as many terms as the one with most taps."""
    order = sorted(taps)
    out = np.array([o for o, _, _ in order], dtype=np.int64)
    term = np.arange(len(out)) - np.searchsorted(out, out)
    index, weight = (np.zeros((int(term.max(initial=-1)) + 1, n_out), dtype=t) for t in (np.int64, float))
    index[term, out], weight[term, out] = [i for _, i, _ in order], [w for _, _, w in order]

    def run(grids: Grids) -> Grids:
        return [sum((np.where(w, g[:, i], 0) * w for i, w in zip(index, weight, strict=True)), np.zeros((len(g), n_out))) for g in grids]

    return run


def two_passes(image: Raster, x_kernel, y_kernel, width: int, height: int) -> Raster:
    """A kernel along x and one along y, each rounded to single precision: a shuffle of the pixels for each, whatever the number of taps."""
    n = len(image.channels)
    half = image.over(along(image, "x", image.width, width, x_kernel), n, width=width)
    return image.over(along(half, "y", image.height, height, y_kernel), n, width=width, height=height)


def merged(taps: Taps) -> Taps:
    """Taps with equal ends added up."""
    sums: dict[tuple[int, int], float] = {}
    for o, s, w in taps:
        sums[o, s] = sums.get((o, s), 0.0) + w
    return [(o, s, w) for (o, s), w in sorted(sums.items())]


def _cubic(t: float, a: float = -0.5) -> float:
    t = abs(t)
    if t <= 1:
        return (a + 2) * t**3 - (a + 3) * t**2 + 1
    return a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a if t < 2 else 0.0


def _lanczos(t: float, a: int = 3) -> float:
    if abs(t) < 1e-12:
        return 1.0
    return a * math.sin(math.pi * t) * math.sin(math.pi * t / a) / (math.pi * t) ** 2 if abs(t) < a else 0.0


FILTERS = {"bilinear": (1, lambda t: max(0.0, 1 - abs(t))), "bicubic": (2, _cubic), "lanczos3": (3, _lanczos)}


def resize_taps(n_in: int, n_out: int, kind: str) -> Taps:
    """Normalised taps of an axis; the support isn't widened when the image shrinks."""
    taps: Taps = []
    for o in range(n_out):
        at = (o + 0.5) * n_in / n_out - 0.5
        if kind == "nearest":
            taps.append((o, min(max(math.floor(at + 0.5), 0), n_in - 1), 1.0))
            continue
        reach, weight = FILTERS[kind]
        base = math.floor(at)
        near = [(i, weight(at - i)) for i in range(base - reach + 1, base + reach + 1)]
        total = sum(w for _, w in near)
        taps += [(o, min(max(i, 0), n_in - 1), w / total) for i, w in near if w]
    return merged(taps)


def resize(image: Raster, width: int, height: int, kind: str) -> Raster:
    if kind not in ("nearest", *FILTERS):
        raise RasterError(f"no filter {kind}")
    if (width, height) == (image.width, image.height):
        return image
    return two_passes(image, tap_kernel(resize_taps(image.width, width, kind), width), tap_kernel(resize_taps(image.height, height, kind), height), width, height)


def domain_warp(source: Raster, displacement: Raster, kind: str = "bilinear", mode: str = "clamp", value: float = 0.0) -> Raster:
    """Samples at (x + dx, y + dy): up to four taps a pixel, joined to the source by place."""
    source.same_extent(displacement)
    d = displacement.settled().table().withColumnsRenamed({"c0": "dx", "c1": "dy"})
    sx, sy = F.col("x") + F.col("dx").cast("double"), F.col("y") + F.col("dy").cast("double")
    if kind == "nearest":
        taps = F.array(F.struct(F.floor(sx + 0.5).cast("int").alias("tx"), F.floor(sy + 0.5).cast("int").alias("ty"), F.lit(1.0).alias("w")))
    else:
        fx, fy = F.floor(sx).cast("int"), F.floor(sy).cast("int")
        ax, ay = sx - F.floor(sx), sy - F.floor(sy)
        corners = [(0, 0, (1 - ax) * (1 - ay)), (1, 0, ax * (1 - ay)), (0, 1, (1 - ax) * ay), (1, 1, ax * ay)]
        taps = F.array(*[F.struct((fx + i).alias("tx"), (fy + j).alias("ty"), w.alias("w")) for i, j, w in corners])
    rows = d.select(*KEYS, F.explode(taps).alias("t"))
    rows = rows.select(*KEYS, bounded(F.col("t.tx"), source.width, mode).alias("sx"), bounded(F.col("t.ty"), source.height, mode).alias("sy"), "t.w")
    n = len(source.channels)
    table = source.table().withColumnsRenamed({"x": "sx", "y": "sy"})
    joined = rows.join(table, ["rid", "sx", "sy"], "left")
    sums = [f32(F.sum(F.coalesce(F.col(f"c{i}").cast("double"), F.lit(value)) * F.col("w"))).alias(f"c{i}") for i in range(n)]
    return source.over(joined.groupBy(*KEYS).agg(*sums), n)
