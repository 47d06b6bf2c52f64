"""Connected components of masks: labelled tile by tile, then joined over the tiles' borders.

A task sees one tile, or the border edges of one raster; the pixels of a raster are never in one task. A component is known by its
first pixel in raster order, ``y * width + x``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.raster import KEYS, Raster, f32, settle

TILE = 256


def first_places(on: np.ndarray, connectivity: int) -> np.ndarray:
    """The place of each component's first pixel, and the number of pixels where the mask is off: least places spread until none changes."""
    h, w = on.shape
    none = h * w
    at = np.where(on, np.arange(h * w).reshape(h, w), none)
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * (connectivity == 8)
    while True:
        padded = np.full((h + 2, w + 2), none)
        padded[1:-1, 1:-1] = at
        low = at
        for dy, dx in steps:
            low = np.minimum(low, np.minimum(padded[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx], padded[1 - dy : h + 1 - dy, 1 - dx : w + 1 - dx]))
        low = np.where(on, low, none)
        flat = np.append(low.ravel(), none)
        jumped = flat[np.minimum(flat[flat], flat)][:-1].reshape(h, w)  # the place that the place has
        low = np.where(on, np.minimum(low, jumped), none)
        if (low == at).all():
            return at
        at = low


def least_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the links, and the least end that each is linked with."""
    nodes, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = both[: len(a)], both[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        p, q = parent[i], parent[j]
        if (p == q).all():
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def components(on: Raster, connectivity: int = 8, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """``rid``, ``y``, ``x``, ``root`` (null where the mask is off) of the pixels, settled; and ``rid``, ``root``, ``first``: each root's component."""
    width, height = on.width, on.height
    table = on.frame.select(*KEYS, (f32(on.channels[0]) > 0).alias("v"), F.expr(f"y DIV {tile}").alias("ty"), F.expr(f"x DIV {tile}").alias("tx"))

    def run(key: tuple, block: pa.Table) -> pa.Table:
        rid, ty, tx = (k.as_py() for k in key)
        h, w = min(tile, height - ty * tile), min(tile, width - tx * tile)
        y, x, v = (block.column(k).to_numpy() for k in ("y", "x", "v"))
        grid = np.zeros((h, w), dtype=bool)
        grid[y - ty * tile, x - tx * tile] = v
        at = first_places(grid, connectivity)[y - ty * tile, x - tx * tile].astype(np.int64)
        root = (ty * tile + at // w) * width + tx * tile + at % w
        return pa.table({"rid": np.full(len(y), rid), "y": y, "x": x, "root": pa.array(root, mask=at == h * w)})

    pixels = settle(table.groupBy("rid", "ty", "tx").applyInArrow(run, "rid long, y int, x int, root long"))
    last = lambda c: F.col(c) % tile == tile - 1
    edge = last("x") | last("y") | (F.col("x") % tile == 0) | (F.col("y") % tile == 0)
    border = pixels.where(F.col("root").isNotNull() & edge)
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * (connectivity == 8)
    beside = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])).alias("p")
    crossing = F.expr(f"p.y DIV {tile} <> y DIV {tile} OR floor(p.x / {tile}) <> x DIV {tile}")
    links = border.select("rid", "y", "x", F.col("root").alias("a"), beside).where(crossing).select("rid", "p.y", "p.x", "a")
    links = links.join(border.withColumnRenamed("root", "b"), KEYS).select("rid", "a", "b").distinct()

    def join(key: tuple, block: pa.Table) -> pa.Table:
        nodes, first = least_linked(block.column("a").to_numpy(), block.column("b").to_numpy())
        return pa.table({"rid": np.full(len(nodes), key[0].as_py()), "root": nodes, "first": first})

    # A raster has at most some 4 * width * height / tile border pixels, and its links are their distinct roots.
    joined = links.groupBy("rid").applyInArrow(join, "rid long, root long, first long")
    roots = pixels.where("root IS NOT NULL").select("rid", "root").distinct()
    return pixels, roots.join(joined, ["rid", "root"], "left").select("rid", "root", F.coalesce("first", "root").alias("first"))


def _hard(mask: Raster, on: Column) -> Raster:
    return mask.but(F.when(on, 1.0).otherwise(0.0))


def _on(mask: Raster) -> Column:
    return ~F.isnan(mask.channels[0]) & (f32(mask.channels[0]) >= 0.5)


def connected_components(mask: Raster, connectivity: int = 8) -> tuple[DataFrame, DataFrame]:
    """``rid``, ``y``, ``x``, ``label`` (numbered from 1 by first pixel, 0 outside the mask); and the area of each label."""
    pixels, groups = components(_hard(mask, _on(mask)), connectivity)
    number = F.dense_rank().over(Window.partitionBy("rid").orderBy("first")).cast("long")
    labels = pixels.join(groups.select("rid", "root", number.alias("label")), ["rid", "root"], "left").select(*KEYS, F.coalesce("label", F.lit(0)).cast("long").alias("label"))
    return labels, labels.where("label > 0").groupBy("rid", "label").agg(F.count("*").alias("area"))


def _by_component(pixels: DataFrame, groups: DataFrame, measure: Column) -> DataFrame:
    """``rid``, ``root`` and the sum of ``measure`` over the pixels of the root's component."""
    each = pixels.where("root IS NOT NULL").groupBy("rid", "root").agg(F.sum(measure).alias("part"))
    whole = groups.join(each, ["rid", "root"]).groupBy("rid", "first").agg(F.sum("part").alias("whole"))
    return groups.join(whole, ["rid", "first"]).select("rid", "root", "whole")


def fill_holes(mask: Raster, connectivity: int = 8) -> Raster:
    """Background that no path of background joins to the border becomes foreground; a hard mask."""
    pixels, groups = components(_hard(mask, ~_on(mask)), connectivity)
    at_edge = F.expr(f"CASE WHEN x IN (0, {mask.width - 1}) OR y IN (0, {mask.height - 1}) THEN 1 ELSE 0 END")
    open_ = pixels.join(_by_component(pixels, groups, at_edge), ["rid", "root"], "left")
    return mask.over(open_.select(*KEYS, F.when(F.col("whole") > 0, 0.0).otherwise(1.0).cast("float").alias("c0")), 1)


def remove_components(mask: Raster, min_area: int, connectivity: int = 8) -> Raster:
    """Components of fewer than ``min_area`` pixels go; a hard mask."""
    pixels, groups = components(_hard(mask, _on(mask)), connectivity)
    sized = pixels.join(_by_component(pixels, groups, F.lit(1)), ["rid", "root"], "left")
    return mask.over(sized.select(*KEYS, F.when(F.col("whole") >= min_area, 1.0).otherwise(0.0).cast("float").alias("c0")), 1)
