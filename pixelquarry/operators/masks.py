"""Masks and signed distance fields: closed forms over (x, y), fuzzy and solid algebra, exact distances."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.blocks import Grids, along
from ..plans.raster import Raster, RasterError, f32, together


def _mask(extent_from: Raster, coverage: Column) -> Raster:
    return Raster(extent_from.frame, (f32(coverage),), extent_from.width, extent_from.height, color="raw-linear")


def empty(extent_from: Raster) -> Raster:
    return _mask(extent_from, F.lit(0.0))


def full(extent_from: Raster) -> Raster:
    return _mask(extent_from, F.lit(1.0))


def rect(extent_from: Raster, x0: float, y0: float, x1: float, y1: float) -> Raster:
    """Exact area coverage."""

    def side(at: Column, low: float, high: float) -> Column:
        return F.greatest(F.least(F.lit(float(high)), at + 1.0) - F.greatest(F.lit(float(low)), at.cast("double")), F.lit(0.0))

    return _mask(extent_from, side(F.col("x"), x0, x1) * side(F.col("y"), y0, y1))


def smoothstep(t: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(t, F.lit(1.0)))
    return t * t * (3.0 - 2.0 * t)


def ellipse(extent_from: Raster, cx: float, cy: float, rx: float, ry: float, angle_rad: float = 0.0, half_width: float = 0.5) -> Raster:
    if rx <= 0 or ry <= 0:
        raise RasterError("radii must be positive")
    dx, dy = F.col("x") + 0.5 - cx, F.col("y") + 0.5 - cy
    cos, sin = math.cos(angle_rad), math.sin(angle_rad)
    u, v = dx * cos + dy * sin, dy * cos - dx * sin
    f = F.sqrt((u / rx) * (u / rx) + (v / ry) * (v / ry))
    slope = F.sqrt((u / (rx * rx)) * (u / (rx * rx)) + (v / (ry * ry)) * (v / (ry * ry)))
    distance = (f - 1.0) * f / F.when(slope > 0, slope).otherwise(1.0)
    edge = 1.0 - smoothstep((distance + half_width) / (2 * half_width)) if half_width > 0 else F.when(distance <= 0, 1.0).otherwise(0.0)
    return _mask(extent_from, F.when(f == 0, 1.0).otherwise(edge))


def polygon(extent_from: Raster, points: list[tuple[float, float]], fill_rule: str = "nonzero", grid: int = 4) -> Raster:
    """Share of a ``grid`` by ``grid`` pattern inside: one unrolled expression over the edges, without a join."""
    edges = list(zip(points, points[1:] + points[:1], strict=True))

    def inside(px: Column, py: Column) -> Column:
        turns = F.lit(0)
        for (ax, ay), (bx, by) in edges:
            if ay == by:
                continue
            crosses = (F.lit(ay) <= py) != (F.lit(by) <= py)
            at = ax + (py - ay) / (by - ay) * (bx - ax)
            turns = turns + F.when(crosses & (px < at), 1 if by > ay else -1).otherwise(0)
        return turns != 0 if fill_rule == "nonzero" else F.pmod(turns, F.lit(2)) == 1

    steps = [(i + 0.5) / grid for i in range(grid)]
    hits = sum((F.when(inside(F.col("x") + sx, F.col("y") + sy), 1).otherwise(0) for sy in steps for sx in steps), F.lit(0))
    return _mask(extent_from, hits / float(grid * grid))


def invert(mask: Raster) -> Raster:
    return mask.but(f32(F.lit(1.0)) - f32(mask.channels[0]))


def _pair(a: Raster, b: Raster, of) -> Raster:
    frame, (ca, cb) = together(a, b)
    return Raster(frame, (f32(of(f32(ca[0]), f32(cb[0]))),), a.width, a.height, color="raw-linear")


def union(a: Raster, b: Raster) -> Raster:
    return _pair(a, b, F.greatest)


def intersect(a: Raster, b: Raster) -> Raster:
    return _pair(a, b, F.least)


def subtract(a: Raster, b: Raster) -> Raster:
    return _pair(a, b, lambda p, q: F.least(p, f32(F.lit(1.0)) - q))


def sdf_union(a: Raster, b: Raster) -> Raster:
    return _pair(a, b, F.least)


def sdf_intersect(a: Raster, b: Raster) -> Raster:
    return _pair(a, b, F.greatest)


def sdf_subtract(a: Raster, b: Raster) -> Raster:
    return _pair(a, b, lambda p, q: F.greatest(p, -q))


def sdf_offset(sdf: Raster, distance_px: float) -> Raster:
    return sdf.but(f32(sdf.channels[0]) - f32(F.lit(distance_px)))


def sdf_to_mask(sdf: Raster, half_width_px: float = 0.0) -> Raster:
    phi = sdf.channels[0].cast("double")
    if half_width_px == 0:
        return sdf.but(F.when(phi <= 0, 1.0).otherwise(0.0))
    inf = F.lit(float("inf"))
    return sdf.but(F.when(phi == inf, 0.0).when(phi == -inf, 1.0).otherwise(smoothstep((half_width_px - phi) / (2 * half_width_px))))


def _gaps(grids: Grids) -> Grids:
    """Along each line the distance to the nearest sample inside, and to the nearest outside; infinite where there is none."""
    out = []
    for seed in (grids[0] > 0, grids[0] == 0):
        at = np.arange(seed.shape[1], dtype=float)
        before = np.maximum.accumulate(np.where(seed, at, -np.inf), axis=1)
        after = np.minimum.accumulate(np.where(seed, at, np.inf)[:, ::-1], axis=1)[:, ::-1]
        out.append(np.minimum(at - before, after - at))
    return out


def _least_squares_along(gap: np.ndarray) -> np.ndarray:
    """For each place x of each line the least (x - i)^2 + gap[i]^2 over i.

    The best i never falls as x grows, so places are settled by halving: the middle one of each open stretch searches only
    between its settled neighbours' best, about two lines' worth of steps for each halving.
    """
    lines, n = gap.shape
    cost = (gap * gap).ravel()
    best = np.full((lines, n + 2), n - 1)  # place x stands at x + 1, between two sentinels
    best[:, 0] = 0
    least = np.empty((lines, n))
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        x = np.arange(step, n + 1, 2 * step)
        low, high = best[:, x - step].ravel(), best[:, np.minimum(x + step, n + 1)].ravel()
        count = high - low + 1
        first = np.cumsum(count) - count
        i = np.arange(int(count.sum())) - np.repeat(first - low, count)
        place, line = np.tile(x - 1, lines), np.repeat(np.arange(lines) * n, len(x))
        away = np.repeat(place, count) - i
        value = away * away + cost[np.repeat(line, count) + i]
        found = np.minimum.reduceat(value, first)
        hit = np.flatnonzero(value == np.repeat(found, count))
        own = np.repeat(np.arange(len(first)), count)[hit]
        best[:, x] = i[hit[np.searchsorted(own, np.arange(len(first)))]].reshape(lines, -1)
        least[:, x - 1] = found.reshape(lines, -1)
        step >>= 1
    return least


def mask_to_sdf(mask: Raster, threshold: float = 0.5) -> Raster:
    """Signed distance between pixel centres, exact: along each column the nearest seed, then along each row the least sum of squares.

    Two line kernels, of linear and n log n time in a line's pixels.
    """
    inside = mask.but(F.when(f32(mask.channels[0]) >= threshold, 1.0).otherwise(0.0))
    near = mask.over(along(inside, "y", mask.height, mask.height, _gaps, missing=-1.0, outputs=2), 2)

    def phi(grids: Grids) -> Grids:
        to_inside, to_outside = (np.sqrt(_least_squares_along(g)) for g in grids)
        return [np.where(np.isinf(to_inside), np.inf, np.where(np.isinf(to_outside), -np.inf, to_inside - np.where(np.isinf(to_outside), 0, to_outside)))]

    return mask.over(along(near, "x", mask.width, mask.width, phi, missing=np.inf, outputs=1), 1)


def grow(mask: Raster, radius_px: float, threshold: float = 0.5) -> Raster:
    return sdf_to_mask(sdf_offset(mask_to_sdf(mask, threshold), radius_px))


def shrink(mask: Raster, radius_px: float, threshold: float = 0.5) -> Raster:
    return grow(mask, -radius_px, threshold)


def feather(mask: Raster, half_width_px: float, threshold: float = 0.5) -> Raster:
    return sdf_to_mask(mask_to_sdf(mask, threshold), half_width_px)
