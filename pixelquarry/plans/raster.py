"""Rasters as tables keyed by (rid, y, x), with lazy channels.

A raster is a frame (a DataFrame with the keys and any columns) and one expression for each channel. Rasters on
one frame combine by projection, in one code-generated stage; only rasters on different frames need a join on the
keys. ``rid`` numbers the rasters of a batch: all have one extent, and every shuffle, window and block kernel is
dealt out by it.
"""

from __future__ import annotations

import itertools
import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["rid", "y", "x"]
_names = itertools.count()


def fresh(stem: str) -> str:
    """A column name that no frame has yet."""
    return f"{stem}{next(_names)}"


def f32(c: Column) -> Column:
    """A sample as stored: each operator rounds its result to single precision."""
    return c.cast("float")


def finite(c: Column) -> Column:
    """Not NaN and not infinite; Spark orders NaN above all numbers, so comparisons need this guard."""
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def settle(frame: DataFrame) -> DataFrame:
    """The frame behind a lineage cut in the folder that ``spark.checkpoint.dir`` names; a local session without it takes a temporary one."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return frame.checkpoint()


class RasterError(ValueError):
    """A parameter or descriptor that an operator doesn't accept."""


@dataclass(frozen=True)
class Raster:
    frame: DataFrame
    channels: tuple[Column, ...]
    width: int
    height: int
    color: str = "linear-srgb"
    alpha: str = "straight"
    range: str = "display-referred"
    has_alpha: bool = False

    def table(self) -> DataFrame:
        """``rid``, ``y``, ``x``, ``c0``.. with single-precision samples."""
        return self.frame.select(*KEYS, *[f32(c).alias(f"c{i}") for i, c in enumerate(self.channels)])

    def over(self, frame: DataFrame, n: int, **changes) -> Raster:
        """A raster on a new frame with columns ``c0``.. for its channels."""
        return replace(self, frame=frame, channels=tuple(F.col(f"c{i}") for i in range(n)), **changes)

    def settled(self) -> Raster:
        """The same raster with plain columns as channels."""
        return self.over(self.table(), len(self.channels))

    def but(self, *channels: Column, **changes) -> Raster:
        return replace(self, channels=tuple(f32(c) for c in channels), **changes)

    @property
    def colors(self) -> tuple[Column, ...]:
        return self.channels[:-1] if self.has_alpha else self.channels

    def same_extent(self, other: Raster) -> None:
        if (self.width, self.height) != (other.width, other.height):
            raise RasterError(f"extents differ: {self.width}x{self.height} and {other.width}x{other.height}")


def together(first: Raster, *others: Raster) -> tuple[DataFrame, list[list[Column]]]:
    """One frame with the channels of all rasters: the first one's, joined by the keys with those that stand on another."""
    frame, columns, joined = first.frame, [list(first.channels)], {id(first.frame): None}
    for other in others:
        first.same_extent(other)
        if id(other.frame) in joined:
            columns.append(list(other.channels))
            continue
        names = [fresh("j") for _ in other.channels]
        side = other.frame.select(*KEYS, *[f32(c).alias(n) for c, n in zip(other.channels, names, strict=True)])
        frame = frame.join(side, KEYS)
        columns.append([F.col(n) for n in names])
    return frame, columns
