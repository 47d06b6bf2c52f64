"""Iterative solvers as block kernels: one raster a task, vectorised over its pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.raster import KEYS, Raster, RasterError, together
from ..sources.generate import mix64

STALL = 16
OMEGA = 1.8


def _solve(rasters: list[Raster], kernel, channels: int, extra: dict[str, str] | None = None) -> DataFrame:
    """``kernel`` on the channel grids of all rasters, joined on one frame; its outputs as ``c0``.. and the ``extra`` columns."""
    first = rasters[0]
    frame, columns = together(*rasters)
    w, h = first.width, first.height
    names = [[f"r{k}_{i}" for i in range(len(c))] for k, c in enumerate(columns)]
    table = frame.select(*KEYS, *[c.cast("float").alias(n) for cs, ns in zip(columns, names, strict=True) for c, n in zip(cs, ns, strict=True)])
    extra = extra or {}

    def run(block: pd.DataFrame) -> pd.DataFrame:
        at = block["y"].to_numpy() * w + block["x"].to_numpy()

        def grid(name: str) -> np.ndarray:
            out = np.zeros(w * h)
            out[at] = block[name].to_numpy()
            return out.reshape(h, w)

        outs, more = kernel([[grid(n) for n in ns] for ns in names])
        data = {"rid": block["rid"].iloc[0], "y": np.repeat(np.arange(h), w), "x": np.tile(np.arange(w), h)}
        data |= {f"c{i}": o.ravel().astype(np.float32) for i, o in enumerate(outs)}
        return pd.DataFrame(data | dict(zip(extra, more, strict=True)))

    return table.groupBy("rid").applyInPandas(run, "rid long, y int, x int, " + ", ".join([f"c{i} float" for i in range(channels)] + [f"{k} {t}" for k, t in extra.items()]))


def _laplace(u: np.ndarray) -> np.ndarray:
    p = np.pad(u, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * u


def _poisson(guide: np.ndarray, start: np.ndarray, anchor: np.ndarray, free: np.ndarray, strength: float, most: int, tolerance: float) -> tuple[np.ndarray, int, float]:
    """(Lap - strength) u = Lap guide - strength * anchor where ``free``; over-relaxed sweeps, first one colour of a chessboard and then the other."""
    free = free.copy()
    free[0], free[-1], free[:, 0], free[:, -1] = False, False, False, False
    u, right = start.copy(), _laplace(guide) - strength * anchor
    color = np.add.outer(np.arange(u.shape[0]), np.arange(u.shape[1])) % 2
    scale = max(float(np.sqrt((right[free] ** 2).sum())), 1e-12) if free.any() else 1.0
    best, since, residual, sweeps = np.inf, 0, 0.0, 0
    for sweeps in range(1, most + 1) if free.any() else []:
        for c in (0, 1):
            part = free & (color == c)
            near = _laplace(u) + 4 * u
            u[part] += OMEGA * ((near[part] - right[part]) / (4 + strength) - u[part])
        residual = float(np.sqrt(((_laplace(u) - strength * u - right)[free] ** 2).sum())) / scale
        if residual <= tolerance:
            break
        best, since = (residual, 0) if residual < best * (1 - 1e-9) else (best, since + 1)
        if since >= STALL:
            break
    return u, sweeps, residual


def poisson_blend(source: Raster, target: Raster, mask: Raster, max_iterations: int = 2000, tolerance: float = 1e-6) -> DataFrame:
    """The target with the source's gradients inside the mask; with the worst channel's sweeps and residual.

    The sweeps go over a chessboard's two colours in turn, which vectorises: the fixed point is that of a row-by-row
    sweep, the number of iterations isn't.
    """

    def kernel(grids):
        found = [_poisson(s, t, t, grids[2][0] > 0.5, 0.0, max_iterations, tolerance) for s, t in zip(grids[0], grids[1], strict=True)]
        return [u for u, _, _ in found], (max(n for _, n, _ in found), max(r for _, _, r in found))

    return _solve([source, target, mask], kernel, len(source.channels), {"iterations": "int", "residual": "double"})


def screened_poisson(guidance: Raster, anchor: Raster, mask: Raster, strength: float, max_iterations: int = 2000, tolerance: float = 1e-6) -> DataFrame:
    if strength < 0:
        raise RasterError("the strength must not be negative")

    def kernel(grids):
        found = [_poisson(g, a, a, grids[2][0] > 0.5, strength, max_iterations, tolerance) for g, a in zip(grids[0], grids[1], strict=True)]
        return [u for u, _, _ in found], (max(n for _, n, _ in found), max(r for _, _, r in found))

    return _solve([guidance, anchor, mask], kernel, len(guidance.channels), {"iterations": "int", "residual": "double"})


def reaction_diffusion(extent_from: Raster, diffusion_u: float = 0.16, diffusion_v: float = 0.08, feed: float = 0.06, kill: float = 0.062, dt: float = 1.0, steps: int = 1000, seed: int = 0) -> DataFrame:
    """Gray-Scott on a torus from a seeded centre square; ``c0`` and ``c1`` are the concentrations, with last residual and energy."""
    if 4 * max(diffusion_u, diffusion_v) * dt > 1:
        raise RasterError("the time step is unstable")

    def kernel(grids):
        h, w = grids[0][0].shape
        u, v = np.ones((h, w)), np.zeros((h, w))
        half = max(1, min(w, h) // 8)
        y, x = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
        square = (abs(x - w // 2) <= half) & (abs(y - h // 2) <= half)
        code = (x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        jitter = (mix64(np.uint64(seed) ^ code) >> np.uint64(40)).astype(np.float64) / (1 << 24)
        u[square], v[square] = 0.5, 0.25 + 0.04 * jitter[square]
        residual = 0.0
        around = lambda a: np.roll(a, 1, 0) + np.roll(a, -1, 0) + np.roll(a, 1, 1) + np.roll(a, -1, 1) - 4 * a
        for _ in range(steps):
            made = u * v * v
            du = dt * (diffusion_u * around(u) + feed * (1 - u) - made)
            dv = dt * (diffusion_v * around(v) - (feed + kill) * v + made)
            u, v, residual = u + du, v + dv, float(np.sqrt((du * du + dv * dv).sum()))
        return [u, v], (residual, float((u * u + v * v).sum()))

    return _solve([extent_from], kernel, 2, {"residual": "double", "energy": "double"})


def optimize_local(init: Raster, target: Raster, mask: Raster, data_weight: float = 1.0, smooth_weight: float = 0.0, step: float = 0.25, max_iterations: int = 500, tolerance: float = 1e-6, enabled: bool = True) -> DataFrame:
    """Simultaneous gradient steps on the data and smoothness terms inside the mask."""

    def descend(u: np.ndarray, t: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, int]:
        u, last, since, n = u.copy(), np.inf, 0, 0
        for n in range(1, max_iterations + 1) if enabled and free.any() else []:
            slope = 2 * data_weight * (u - t) - 2 * smooth_weight * _laplace(u)
            u = np.where(free, u - step * slope, u)
            dy, dx = np.diff(u, axis=0), np.diff(u, axis=1)
            value = data_weight * ((u - t)[free] ** 2).sum() + smooth_weight * ((dy * dy).sum() + (dx * dx).sum())
            if abs(last - value) <= tolerance * max(abs(value), 1e-12):
                break
            since = 0 if value < last else since + 1
            last = value
            if since >= STALL:
                break
        return u, n

    def kernel(grids):
        found = [descend(u, t, grids[2][0] > 0.5) for u, t in zip(grids[0], grids[1], strict=True)]
        return [u for u, _ in found], (max(n for _, n in found),)

    return _solve([init, target, mask], kernel, len(init.channels), {"iterations": "int"})


def patch_field(source: Raster, target: Raster, radius: int, target_mask: Raster | None = None, source_mask: Raster | None = None) -> DataFrame:
    """``src_x``, ``src_y``, ``cost``: for each pixel of the target the source patch of least squared distance, the first in raster order.

    The exact nearest patch over all anchors, rather than a seeded search that approaches it. Only pixels over 0.5 of
    ``target_mask`` are matched, the others keep their own place at cost 0; only those of ``source_mask`` are anchors, and without
    any a matched pixel keeps its place at infinite cost.
    """
    masks = [m for m in (target_mask, source_mask) if m is not None]
    some_wanted, some_anchors = target_mask is not None, source_mask is not None  # the kernel can't hold the rasters

    def patches(grids: list[np.ndarray]) -> np.ndarray:
        h, w = grids[0].shape
        out = []
        for g in grids:
            p = np.pad(g, radius, mode="edge")
            out += [p[j : j + h, i : i + w].ravel() for j in range(2 * radius + 1) for i in range(2 * radius + 1)]
        return np.stack(out, axis=1)

    def kernel(grids):
        s, t = patches(grids[0]), patches(grids[1])
        best, cost = np.arange(len(t)), np.zeros(len(t))
        wanted = np.flatnonzero(grids[2][0].ravel() > 0.5) if some_wanted else best.copy()
        anchors = np.flatnonzero(grids[-1][0].ravel() > 0.5) if some_anchors else np.arange(len(s))
        if not len(anchors):
            cost[wanted], wanted = np.inf, wanted[:0]
        s = s[anchors]
        for a in range(0, len(wanted), 64):  # a strip of target pixels against all anchors
            at = wanted[a : a + 64]
            d = np.zeros((len(at), len(s)))
            for k in range(s.shape[1]):
                d += (t[at, k, None] - s[None, :, k]) ** 2
            best[at], cost[at] = anchors[d.argmin(axis=1)], d.min(axis=1)
        w = grids[0][0].shape[1]
        return [], ((best % w).astype(np.int32), (best // w).astype(np.int32), cost)

    return _solve([source, target, *masks], kernel, 0, {"src_x": "int", "src_y": "int", "cost": "double"})


def patch_synthesize(source: Raster, target: Raster, field: DataFrame, hole: Raster) -> Raster:
    """Inside the hole the source's sample at the field's anchor, else the target's: an equi-join on the anchor."""
    n = len(source.channels)
    side = source.table().select("rid", F.col("y").alias("src_y"), F.col("x").alias("src_x"), *[F.col(f"c{i}").alias(f"s{i}") for i in range(n)])
    frame, (t, (m,)) = together(target, hole)
    base = frame.select(*KEYS, *[c.cast("float").alias(f"t{i}") for i, c in enumerate(t)], m.cast("float").alias("m"))
    joined = base.join(field.select(*KEYS, "src_y", "src_x"), KEYS).join(side, ["rid", "src_y", "src_x"], "left")
    return target.over(joined.select(*KEYS, *[F.when(F.col("m") > 0.5, F.col(f"s{i}")).otherwise(F.col(f"t{i}")).alias(f"c{i}") for i in range(n)]), n)
