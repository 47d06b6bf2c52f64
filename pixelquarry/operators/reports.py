"""Reports and assertions: one aggregate for each raster. Every extremum has an explicit guard against non-finite samples."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.raster import KEYS, Raster, RasterError, f32, finite, together
from .frequency import laplacian_split
from .pointwise import srgb_decode

ENERGY_EPSILON = 1e-9
LOCATIONS = 256
INF = float("inf")


def _long(image: Raster, mask: Raster | None = None) -> DataFrame:
    """``rid``, ``y``, ``x``, ``ch``, ``v`` of every sample, and ``m`` if there is a mask."""
    frame, columns = together(image, *([mask] if mask else []))
    samples = F.array(*[F.struct(F.lit(i).alias("ch"), c.cast("float").cast("double").alias("v")) for i, c in enumerate(columns[0])])
    extra = [columns[1][0].cast("float").alias("m")] if mask else []
    return frame.select(*KEYS, *extra, F.explode(samples).alias("s")).select(*KEYS, "s.ch", "s.v", *(["m"] if mask else []))


def inspect(image: Raster) -> DataFrame:
    """Extrema and sums over the finite samples of each channel, and counts."""
    ok, v = finite(F.col("v")), F.col("v")
    good = F.when(ok, v)
    return _long(image).groupBy("rid", "ch").agg(
        F.min(good).alias("v_min"), F.max(good).alias("v_max"), F.coalesce(F.sum(good), F.lit(0.0)).alias("v_sum"), F.coalesce(F.sum(good * good), F.lit(0.0)).alias("v_sum_sq"),
        F.count_if(ok).alias("n_finite"), F.count_if(~ok).alias("n_nonfinite"),
    )


def content_hash(image: Raster) -> DataFrame:
    """SHA-256 of each raster's extent, channels and little-endian samples in order, every NaN in one form; a raster a task."""
    n, w, h = len(image.channels), image.width, image.height

    def digest(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["y", "x"])
        data = block[[f"c{i}" for i in range(n)]].to_numpy(dtype="<f4")
        bits = np.ascontiguousarray(data).view("<u4").copy()
        bits[np.isnan(data)] = 0x7FC00000
        head = np.array([w, h, n], dtype="<u4").tobytes()
        return pd.DataFrame({"rid": [block["rid"].iloc[0]], "content_hash": ["sha256:" + hashlib.sha256(head + bits.tobytes()).hexdigest()]})

    return image.table().groupBy("rid").applyInPandas(digest, "rid long, content_hash string")


def statistics(image: Raster, mask: Raster | None = None) -> DataFrame:
    rows = _long(image, mask)
    if mask:
        rows = rows.where((F.col("m") > 0) & ~F.isnan("m"))
    v = F.when(finite(F.col("v")), F.col("v"))
    out = rows.groupBy("rid", "ch").agg(F.count(v).alias("n"), F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.sum(v).alias("v_sum"), F.var_pop(v).alias("variance"))
    mean = F.col("v_sum") / F.col("n")
    return out.where("n > 0").select("rid", "ch", "n", "v_min", "v_max", "v_sum", mean.alias("mean"), "variance")


def histogram(image: Raster, bins: int, domain_min: float, domain_max: float) -> DataFrame:
    """Counts of every bin, empty ones too; -1 below the domain, ``bins`` above it, ``bins + 1`` not finite. The top edge falls in the last bin.

    One aggregate counts the samples, and the zeros are added to its far fewer rows.
    """
    if not 1 <= bins <= 1 << 20 or domain_max <= domain_min:
        raise RasterError("bins or domain are out of range")
    v, width = F.col("v"), (domain_max - domain_min) / bins
    place = F.least(F.floor((v - domain_min) / width), F.lit(bins - 1)).cast("int")
    which = F.when(~finite(v), bins + 1).when(v < domain_min, -1).when(v > domain_max, bins).otherwise(place)
    zeros = F.explode(F.sequence(F.lit(-1), F.lit(bins + 1)))
    channels = F.explode(F.array(*[F.lit(i) for i in range(len(image.channels))]))
    empty = image.frame.select("rid").distinct().select("rid", channels.alias("ch")).select("rid", "ch", zeros.alias("bin"), F.lit(0).cast("long").alias("n"))
    counts = _long(image).groupBy("rid", "ch", which.alias("bin")).agg(F.count("*").alias("n"))
    return counts.unionByName(empty).groupBy("rid", "ch", "bin").agg(F.sum("n").alias("n"))


def bounds(mask: Raster) -> DataFrame:
    """Tight half-open box of the finite coverage above 0, and the finite coverage's maximum, mean and root mean square."""
    m = mask.channels[0].cast("float").cast("double")
    rows = mask.frame.select(*KEYS, m.alias("m"))
    on = finite(F.col("m")) & (F.col("m") > 0)
    fine = F.when(finite(F.col("m")), F.col("m"))
    return rows.groupBy("rid").agg(
        F.min(F.when(on, F.col("x"))).alias("x0"), F.min(F.when(on, F.col("y"))).alias("y0"), (F.max(F.when(on, F.col("x"))) + 1).alias("x1"), (F.max(F.when(on, F.col("y"))) + 1).alias("y1"),
        F.count_if(on).alias("n"), F.max(fine).alias("v_max"), F.avg(fine).alias("mean"), F.sqrt(F.avg(fine * fine)).alias("rms"),
    )


def _delta(before: Raster, after: Raster, space: str) -> Raster:
    """Absolute differences, decoded first if the comparison space is decoded-linear and the images are sRGB; alpha is decoded too."""
    frame, (b, a) = together(before, after)
    curve = srgb_decode if space == "decoded-linear" and before.color == "srgb" else lambda c: c.cast("double")
    return Raster(frame, tuple(F.abs(curve(q) - curve(p)).cast("float") for p, q in zip(b, a, strict=True)), before.width, before.height, "raw-linear")


def diff(before: Raster, after: Raster, space: str = "decoded-linear", threshold: float = 0.0) -> tuple[Raster, DataFrame]:
    field = _delta(before, after, space)
    fine = [F.when(finite(c), c.cast("double")) for c in field.channels]
    top = _greatest(fine)
    rows = field.frame.select(*KEYS, F.coalesce(top, F.lit(0.0)).alias("d"), F.array_compact(F.array(*fine)).alias("all"))
    total = F.sum(F.aggregate("all", F.lit(0.0), lambda t, v: t + v))
    square = F.sum(F.aggregate("all", F.lit(0.0), lambda t, v: t + v * v))
    n = F.sum(F.size("all"))
    on = F.col("d") > threshold
    report = rows.groupBy("rid").agg(F.max("d").alias("v_max"), (total / n).alias("mean"), F.sqrt(square / n).alias("rms"), *_box_of(on))
    return field, report


def _greatest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def _box_of(on: Column) -> list[Column]:
    x, y = F.when(on, F.col("x")), F.when(on, F.col("y"))
    return [F.count_if(on).alias("n"), F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) + 1).alias("x1"), (F.max(y) + 1).alias("y1")]


def changed_bounds(field: Raster, threshold: float = 0.0) -> DataFrame:
    top = _greatest([F.when(finite(c), F.abs(c.cast("double"))) for c in field.channels])
    return field.frame.select(*KEYS, F.coalesce(top, F.lit(0.0)).alias("d")).groupBy("rid").agg(*_box_of(F.col("d") > threshold))


def frequency_energy(image: Raster, bands: int, mask: Raster | None = None, inverse: bool = False) -> DataFrame:
    """Sum of squares and pixels of each band, with pixels outside the mask (or, if ``inverse``, inside it) put to zero."""
    if mask:
        frame, (c, (m,)) = together(image, mask)
        keep = (m > 0) & ~F.isnan(m)
        image = Raster(frame, tuple(F.when(~keep if inverse else keep, v).otherwise(0.0).cast("float") for v in c), image.width, image.height, image.color)
    out = None
    for level, band in enumerate(laplacian_split(image, bands)):
        table = _long(band)
        part = table.groupBy("rid").agg(F.sum(F.col("v") * F.col("v")).alias("energy"), F.lit(band.width * band.height).cast("long").alias("n")).select("rid", F.lit(level).alias("level"), "energy", "n")
        out = part if out is None else out.unionByName(part)
    return out


def _verdict(rows: DataFrame, excess: Column, bad: Column) -> DataFrame:
    """Violations of each raster, the worst excess and its first place, and ``places``: the first ``LOCATIONS`` of them in raster order.

    The capped list is what the report has. Each task keeps a raster's first places only, and each of its lists is merged under the cap.
    """
    tagged = rows.select(*KEYS, excess.alias("excess"), bad.alias("bad"))
    place = F.struct("excess", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    out = tagged.groupBy("rid").agg(F.count_if("bad").alias("n"), F.max(F.when(F.col("bad"), place)).alias("worst"))
    order = Window.partitionBy("rid").orderBy("y", "x")
    first = tagged.where("bad").withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= LOCATIONS)
    places = first.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("places"))
    none = F.array().cast("array<struct<y:int,x:int>>")
    return out.join(places, "rid", "left").select(
        "rid", (F.col("n") == 0).alias("passed"), "n", F.col("worst.excess").alias("excess"), (-F.col("worst.y")).alias("y"), (-F.col("worst.x")).alias("x"), F.coalesce("places", none).alias("places")
    )


def locations(report: DataFrame) -> DataFrame:
    """``rid``, ``y``, ``x`` of a report's listed violations, a row each."""
    return report.select("rid", F.explode("places").alias("p")).select("rid", "p.y", "p.x")


def assert_finite(image: Raster) -> DataFrame:
    bad = ~F.forall(F.array(*[c.cast("double") for c in image.channels]), finite)
    rows = image.frame.select(*KEYS, bad.alias("bad"))
    return _verdict(rows, F.lit(INF), F.col("bad"))


def assert_range(image: Raster, low: float, high: float) -> DataFrame:
    """A sample that isn't finite is a violation with infinite excess."""

    def excess(c: Column) -> Column:
        v = c.cast("double")
        return F.when(~finite(v), INF).otherwise(F.greatest(F.lit(low) - v, v - F.lit(high), F.lit(0.0)))

    rows = image.frame.select(*KEYS, _greatest([excess(c) for c in image.channels]).alias("e"))
    return _verdict(rows, F.col("e"), F.col("e") > 0)


def assert_alpha_valid(image: Raster) -> DataFrame:
    if not image.has_alpha:
        raise RasterError("the image has no alpha")
    a = image.channels[-1].cast("double")
    worst = [F.when(~finite(a), INF).otherwise(F.greatest(-a, a - 1.0, F.lit(0.0)))]
    if image.alpha == "premultiplied":
        worst += [F.when(finite(a), F.greatest(F.abs(c.cast("double")) - a, F.lit(0.0))).otherwise(0.0) for c in image.colors]
    rows = image.frame.select(*KEYS, _greatest(worst).alias("e"))
    return _verdict(rows, F.col("e"), F.col("e") > 0)


def assert_changed_bounds(before: Raster, after: Raster, box: tuple[int, int, int, int], threshold: float = 0.0) -> DataFrame:
    field = _delta(before, after, "decoded-linear")
    top = F.coalesce(_greatest([F.when(~F.isnan(c), c.cast("double")) for c in field.channels]), F.lit(0.0))
    x0, y0, x1, y1 = box
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    return _verdict(field.frame.select(*KEYS, top.alias("d")), F.col("d"), (F.col("d") > threshold) & ~inside)


def assert_no_change_outside_mask(before: Raster, after: Raster, allowed: Raster, space: str = "decoded-linear", outside_threshold: float = 0.0, coverage_epsilon: float = 0.0) -> DataFrame:
    """Coverage and ``coverage_epsilon`` are compared in single precision, so a sample stored as 0.1 is within 0.1."""
    field = _delta(before, after, space)
    frame, (d, (m,)) = together(field, allowed)
    top = F.coalesce(_greatest([F.when(~F.isnan(c), c.cast("double")) for c in d]), F.lit(0.0))
    rows = frame.select(*KEYS, top.alias("d"), m.cast("float").alias("m"))
    return _verdict(rows, F.col("d"), (F.col("m") <= f32(F.lit(coverage_epsilon))) & (F.col("d") > outside_threshold))


def assert_frequency_preserved(before: Raster, after: Raster, bands: int, tolerance: float = 0.05, mask: Raster | None = None) -> DataFrame:
    """The worst relative change of a band's energy outside the mask, and how many bands change by more than ``tolerance``."""
    b, a = (frequency_energy(r, bands, mask, inverse=True).select("rid", "level", F.col("energy").alias(n)) for r, n in ((before, "e_before"), (after, "e_after")))
    change = F.abs(F.col("e_after") - F.col("e_before")) / (F.col("e_before") + ENERGY_EPSILON)
    rows = b.join(a, ["rid", "level"]).withColumn("change", change)
    out = rows.groupBy("rid").agg(F.count_if(F.col("change") > tolerance).alias("n"), F.max("change").alias("worst"), F.max_by(F.col("level"), F.struct("change", -F.col("level"))).alias("level"))
    return out.select("rid", (F.col("n") == 0).alias("passed"), "n", "worst", "level")
