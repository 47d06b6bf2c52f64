"""Kernels over lines and tiles: Spark deals the pixels out and sorts them, numpy works on a bounded block at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import KEYS, Raster

#: Samples of a channel that a line kernel sees at once, and the least side of a tile's output.
BLOCK, SIDE = 1 << 18, 64
Grids = list[np.ndarray]
#: (tile, place in the padded tile, source index)
Places = list[tuple[int, int, int]]


def _whole_lines(batches: Iterator[pa.RecordBatch], other: str) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that no line is cut; what is held back is the last line alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rid, at = batch.column("rid").to_numpy(), batch.column(other).to_numpy()
        new = np.flatnonzero((rid != rid[-1]) | (at != at[-1]))
        begin = int(new[-1]) + 1 if len(new) else 0  # of the batch's last line
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if begin or (last.column("rid")[0].as_py(), last.column(other)[0].as_py()) != (int(rid[0]), int(at[0])):
                yield pa.Table.from_batches([*held, batch.slice(0, begin)])
                held = []
        elif begin:
            yield pa.Table.from_batches([batch.slice(0, begin)])
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def along(image: Raster, axis: str, n_in: int, n_out: int, kernel: Callable[[Grids], Grids], missing: float = 0.0, outputs: int | None = None) -> DataFrame:
    """Each row (``axis`` x) or column (``axis`` y) through ``kernel``, which maps grids of (lines, ``n_in``) to grids of (lines, ``n_out``).

    One shuffle and one sort of the pixels by line; a task holds an Arrow batch and the line that it ends in. Samples that a
    line lacks read ``missing``; each line that has a pixel gets all its output pixels.
    """
    n, other = len(image.channels), "y" if axis == "x" else "x"
    m = n if outputs is None else outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lines(batches, other):
            rid, at, place = (table.column(k).to_numpy() for k in ("rid", other, axis))
            first = np.flatnonzero(np.concatenate(([True], (rid[1:] != rid[:-1]) | (at[1:] != at[:-1]))))
            line = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rid))))
            samples = [table.column(f"c{i}").to_numpy() for i in range(n)]
            step = max(1, BLOCK // max(n_in, n_out))
            for a in range(0, len(first), step):
                some = first[a : a + step]
                rows = slice(int(some[0]), int(first[a + step]) if a + step < len(first) else len(rid))
                grids = []
                for s in samples:
                    grids.append(np.full((len(some), n_in), missing))
                    grids[-1][line[rows] - a, place[rows]] = s[rows]
                found = [g.astype(np.float32).ravel() for g in kernel(grids)]
                columns = [np.repeat(rid[some], n_out), np.repeat(at[some], n_out), np.tile(np.arange(n_out, dtype=np.int32), len(some)), *found]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rid", other, axis, *[f"c{i}" for i in range(m)]])

    lines = image.table().repartition("rid", other).sortWithinPartitions("rid", other)
    return lines.mapInArrow(run, f"rid long, {other} int, {axis} int, " + ", ".join(f"c{i} float" for i in range(m))).select(*KEYS, *[f"c{i}" for i in range(m)])


def tile_places(n_in: int, n_out: int, size: int, at: int, index: Callable[[int], int | None]) -> tuple[int, Places]:
    """The side of a tile, and where each source index stands in the padded tiles of an axis; place -1 only keeps a tile alive."""
    side = max(SIDE, size)
    places: Places = []
    for tile in range(-(-n_out // side)):
        begin, end = tile * side, min((tile + 1) * side, n_out)
        places.append((tile, -1, min(begin, n_in - 1)))
        places += [(tile, p, i) for p in range(end - begin + size - 1) if (i := index(begin + p - at)) is not None]
    return side, places


def tiled(image: Raster, xs: tuple[int, Places], ys: tuple[int, Places], size: tuple[int, int], extent: tuple[int, int], kernel: Callable[[Grids], Grids], missing: float = 0.0) -> DataFrame:
    """Tiles with a halo of a neighbourhood of ``size`` (width, height) through ``kernel``: padded grids in, output grids out.

    A pixel travels to the tiles that see it, at most four times as many rows as there are pixels; the kernel's taps make no rows.
    """
    n, (width, height) = len(image.channels), extent
    spark = image.frame.sparkSession
    sx, sy = xs[0], ys[0]
    columns = spark.createDataFrame(xs[1], "tx int, px int, x int")
    rows = spark.createDataFrame(ys[1], "ty int, py int, y int")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rid, ty, tx = (k.as_py() for k in key)
        w, h = min(sx, width - tx * sx), min(sy, height - ty * sy)
        px, py = table.column("px").to_numpy(), table.column("py").to_numpy()
        there = (px >= 0) & (py >= 0)
        grids = []
        for i in range(n):
            grids.append(np.full((h + size[1] - 1, w + size[0] - 1), missing))
            grids[-1][py[there], px[there]] = table.column(f"c{i}").to_numpy()[there]
        y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
        found = [g.astype(np.float32).ravel() for g in kernel(grids)]
        out = [np.full(h * w, rid), (y + ty * sy).astype(np.int32), (x + tx * sx).astype(np.int32), *found]
        return pa.table([pa.array(c) for c in out], [*KEYS, *[f"c{i}" for i in range(n)]])

    dealt = image.table().join(F.broadcast(columns), "x").join(F.broadcast(rows), "y")  # an axis' places, at most four for each sample
    return dealt.groupBy("rid", "ty", "tx").applyInArrow(run, "rid long, y int, x int, " + ", ".join(f"c{i} float" for i in range(n)))
