"""Paint and composite: co-located joins that collapse to projections on one frame."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.raster import KEYS, Raster, RasterError, f32, fresh, together


def _result(like: Raster, frame, channels) -> Raster:
    return Raster(frame, tuple(f32(c) for c in channels), like.width, like.height, like.color, like.alpha, like.range, like.has_alpha)


def _between(m: Column, base: Column, top: Column) -> Column:
    """``base + m (top - base)``; at 0 and 1 the operands themselves."""
    return F.when(m == 0, base).when(m == 1, top).otherwise(f32(base + m * (top - base)))


def fill(image: Raster, mask: Raster, value: list[float]) -> Raster:
    if len(value) != len(image.channels):
        raise RasterError("one value for each channel")
    frame, (base, (m,)) = together(image, mask)
    return _result(image, frame, [_between(f32(m), f32(c), f32(F.lit(v))) for c, v in zip(base, value, strict=True)])


def masked_replace(edited: Raster, base: Raster, mask: Raster) -> Raster:
    frame, (new, old, (m,)) = together(edited, base, mask)
    return _result(base, frame, [_between(f32(m), f32(b), f32(e)) for e, b in zip(new, old, strict=True)])


def over(src: Raster, dst: Raster) -> Raster:
    if not (src.has_alpha and dst.has_alpha and src.alpha == dst.alpha == "premultiplied"):
        raise RasterError("over needs premultiplied alpha on both sides")
    frame, (s, d) = together(src, dst)
    keep = f32(F.lit(1.0)) - f32(s[-1])
    return _result(dst, frame, [f32(a) + f32(b) * keep for a, b in zip(s, d, strict=True)])


BLENDS = {
    "normal": lambda s, d: s,
    "over": lambda s, d: s,
    "add": lambda s, d: s + d,
    "subtract": lambda s, d: d - s,
    "multiply": lambda s, d: s * d,
    "screen": lambda s, d: s + d - s * d,
    "darken": F.least,
    "lighten": F.greatest,
    "difference": lambda s, d: F.abs(s - d),
}


def blend(src: Raster, dst: Raster, mask: Raster, mode: str, opacity: float = 1.0) -> Raster:
    """``dst + k (B(src, dst) - dst)`` on every channel, with ``k`` the opacity times the coverage."""
    if mode not in BLENDS:
        raise RasterError(f"no mode {mode}")
    frame, (s, d, (m,)) = together(src, dst, mask)
    k = f32(F.lit(opacity)) * f32(m)
    return _result(dst, frame, [F.when(k == 0, f32(b)).otherwise(f32(b) + k * (BLENDS[mode](f32(a), f32(b)) - f32(b))) for a, b in zip(s, d, strict=True)])


Stop = tuple[float, list[float]]


def _ladder(t: Column, stops: list[Stop], channel: int) -> Column:
    """The colour at ``t``: a stop's own value where it is hit, else between its neighbours."""
    stops = sorted(stops, key=lambda s: s[0])
    if stops[0][0] != 0 or stops[-1][0] != 1:
        raise RasterError("stops must stand at 0 and 1")
    out = F.lit(float(stops[-1][1][channel]))
    for (p, a), (q, b) in reversed(list(zip(stops, stops[1:], strict=False))):
        if q == p:
            continue
        low, high = a[channel], b[channel]
        step = F.when(t == p, float(low)).otherwise(low + (t - p) / (q - p) * (high - low))
        out = F.when(t < q, step).otherwise(out)
    return out


def _gradient(extent_from: Raster, t: Column, stops: list[Stop], has_alpha: bool) -> Raster:
    t = F.greatest(F.lit(0.0), F.least(t, F.lit(1.0)))
    n = len(stops[0][1])
    return Raster(extent_from.frame, tuple(f32(_ladder(t, stops, i)) for i in range(n)), extent_from.width, extent_from.height, "srgb", has_alpha=has_alpha)


def linear_gradient(extent_from: Raster, start: tuple[float, float], end: tuple[float, float], stops: list[Stop], has_alpha: bool = True) -> Raster:
    dx, dy = end[0] - start[0], end[1] - start[1]
    if dx == dy == 0:
        raise RasterError("start and end are one point")
    t = ((F.col("x") + 0.5 - start[0]) * dx + (F.col("y") + 0.5 - start[1]) * dy) / (dx * dx + dy * dy)
    return _gradient(extent_from, t, stops, has_alpha)


def radial_gradient(extent_from: Raster, center: tuple[float, float], radius: float, stops: list[Stop], has_alpha: bool = True) -> Raster:
    if radius <= 0:
        raise RasterError("the radius must be positive")
    dx, dy = F.col("x") + 0.5 - center[0], F.col("y") + 0.5 - center[1]
    return _gradient(extent_from, F.sqrt(dx * dx + dy * dy) / radius, stops, has_alpha)


#: Splats that one expression holds, and the squared distance in sigmas from which a weight is exactly 0 in doubles.
EXPRESSION_SPLATS, SUPPORT = 16, 1500.0
SPLAT_BLENDS = ("normal", "multiply", "add", "screen", "lighten")


def _splat_batches(base: Raster, splats: list[dict]) -> DataFrame:
    """The fold on Arrow batches of pixels; the table of splats goes to every task, ``max_splats`` rows of 15 numbers at most."""
    rows = []
    for s in splats:
        (sx, sy), t = s["sigma_px"], s.get("angle_rad", 0.0)
        cos, sin = math.cos(t), math.sin(t)
        reach = [math.sqrt(SUPPORT * ((p * sx) ** 2 + (q * sy) ** 2)) + 1 for p, q in ((cos, sin), (sin, cos))]
        rows.append([*s["center_px"], *reach, sx, sy, cos, sin, 1 + 7 * s.get("hardness", 0.0), s.get("opacity", 1.0), SPLAT_BLENDS.index(s.get("blend", "normal")), *s["color"]])
    table = np.array(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            px, py = (batch.column(k).to_numpy() + 0.5 for k in ("x", "y"))
            d = np.stack([batch.column(f"c{i}").to_numpy().astype(float) for i in range(4)])
            cx, cy, rx, ry = table[:, :4].T
            for k in np.flatnonzero((cx + rx >= px.min()) & (cx - rx <= px.max()) & (cy + ry >= py.min()) & (cy - ry <= py.max())):
                x, y, rx_k, ry_k, sx, sy, cos, sin, power, opacity, blend, *color = table[k]
                at = np.flatnonzero((np.abs(px - x) <= rx_k) & (np.abs(py - y) <= ry_k))
                dx, dy, old = px[at] - x, py[at] - y, d[:, at]
                u, v = (dx * cos + dy * sin) / sx, (dy * cos - dx * sin) / sy
                cover = color[3] * (opacity * np.exp(-0.5 * (u * u + v * v) ** power))
                new = np.array([*color[:3], 1.0])[:, None] * cover
                mode = SPLAT_BLENDS[int(blend)]
                if mode == "normal":
                    d[:, at] = old * (1 - cover) + new
                elif mode == "multiply":
                    d[:3, at] = old[:3] * (1 - cover) + old[:3] * np.array(color[:3])[:, None] * cover
                    d[3, at] = old[3] * (1 - cover) + cover
                else:
                    d[:, at] = {"add": old + new, "screen": old + new - old * new, "lighten": np.maximum(old, new)}[mode]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in KEYS], *[pa.array(c.astype(np.float32)) for c in d]], batch.schema.names)

    return base.table().mapInArrow(run, "rid long, y int, x int, c0 float, c1 float, c2 float, c3 float")


def gaussian_splats(base: Raster, splats: list[dict], max_splats: int = 100_000) -> Raster:
    """An ordered fold of anisotropic Gaussians over premultiplied samples; their order is part of the result.

    A splat has ``center_px``, ``sigma_px``, ``angle_rad``, ``color`` (RGBA), ``opacity``, ``blend`` and ``hardness``. A few are one expression for each
    channel; more than ``EXPRESSION_SPLATS`` go over the pixels a batch at a time, where each splat meets only the pixels in its support. Neither shuffles.
    """
    if len(splats) > max_splats:
        raise RasterError("too many splats")
    if any(min(s["sigma_px"]) <= 0 for s in splats):
        raise RasterError("sigma must be positive")
    if len(splats) > EXPRESSION_SPLATS:
        return base.over(_splat_batches(base, splats), len(base.channels))
    state = [c.cast("double") for c in base.channels]
    frame = base.frame
    names = [fresh("s") for _ in state]
    frame = frame.select("*", *[c.alias(n) for c, n in zip(state, names, strict=True)])
    for s in splats:
        d = [F.col(n) for n in names]
        dx, dy = F.col("x") + 0.5 - s["center_px"][0], F.col("y") + 0.5 - s["center_px"][1]
        cos, sin = math.cos(s.get("angle_rad", 0.0)), math.sin(s.get("angle_rad", 0.0))
        u, v = (dx * cos + dy * sin) / s["sigma_px"][0], (dy * cos - dx * sin) / s["sigma_px"][1]
        power = 1 + 7 * s.get("hardness", 0.0)
        w = s.get("opacity", 1.0) * F.exp(-0.5 * F.pow(u * u + v * v, F.lit(power)))
        r, g, b, a = s["color"]
        sa = a * w
        src = [r * sa, g * sa, b * sa, sa]
        mode = s.get("blend", "normal")
        colors = (r, g, b)
        if mode == "normal":
            new = [x * (1 - sa) + y for x, y in zip(d, src, strict=True)]
        elif mode == "multiply":
            new = [x * (1 - sa) + x * c * sa for x, c in zip(d, colors, strict=False)] + [d[3] * (1 - sa) + sa]
        else:
            kind = {"add": lambda x, y: x + y, "screen": lambda x, y: x + y - x * y, "lighten": F.greatest}[mode]
            new = [kind(x, y) for x, y in zip(d, src, strict=True)]
        frame = frame.withColumns(dict(zip(names, new, strict=True)))
    return _result(base, frame, [F.col(n) for n in names])

