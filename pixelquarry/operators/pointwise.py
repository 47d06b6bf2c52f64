"""Pointwise operators: colour, alpha, channels, tensors. All are projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.raster import Raster, RasterError, f32, settle, together

# The sRGB transfer curve and the Rec. 709 luma weights.
SRGB_KNEE, LINEAR_KNEE = 0.04045, 0.0031308
LUMA = (0.2126, 0.7152, 0.0722)
UNPREMULTIPLY_EPSILON = 1e-6


def srgb_decode(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c <= SRGB_KNEE, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def srgb_encode(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c <= LINEAR_KNEE, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def extract_channel(image: Raster, channel: int) -> Raster:
    if not 0 <= channel < len(image.channels):
        raise RasterError(f"no channel {channel}")
    return image.but(image.channels[channel], color="raw-linear", has_alpha=False)


def assemble_channels(*fields: Raster, has_alpha: bool = False) -> Raster:
    frame, columns = together(*fields)
    return Raster(frame, tuple(c[0] for c in columns), fields[0].width, fields[0].height, color="raw-linear", has_alpha=has_alpha)


def convert(image: Raster, source: str, target: str) -> Raster:
    if source != image.color:
        raise RasterError(f"the image is {image.color}, not {source}")
    if source == target:
        return image
    curve = {("srgb", "linear-srgb"): srgb_decode, ("linear-srgb", "srgb"): srgb_encode}.get((source, target))
    if curve is None:
        raise RasterError(f"no conversion from {source} to {target}")
    return image.but(*[curve(c) for c in image.colors], *image.channels[len(image.colors) :], color=target)


def adjust(image: Raster, exposure_ev: float = 0.0, saturation: float = 0.0, temperature: float = 0.0, mask: Raster | None = None) -> Raster:
    """Exposure, then temperature, then saturation around the luma of the tinted pixel; by a mask's coverage if there is one."""
    if image.color == "srgb":
        raise RasterError("adjust works on linear images")
    frame, columns = together(image, *([mask] if mask else []))
    base = columns[0]
    gain = 2.0**exposure_ev
    r, g, b = (c.cast("double") * gain for c in base[:3])
    r, b = r * (1 + temperature), b * (1 - temperature)
    luma = LUMA[0] * r + LUMA[1] * g + LUMA[2] * b
    new = [f32(luma + (1 + saturation) * (c - luma)) for c in (r, g, b)]
    if mask:
        m = columns[1][0].cast("double")
        new = [old + m * (c - old) for c, old in zip(new, base, strict=False)]
    return Raster(frame, tuple(f32(c) for c in [*new, *base[3:]]), image.width, image.height, image.color, image.alpha, image.range, image.has_alpha)


def premultiply(image: Raster) -> Raster:
    if not image.has_alpha or image.alpha != "straight" or image.color == "srgb":
        raise RasterError("premultiply needs linear colour with straight alpha")
    a = f32(image.channels[-1])
    return image.but(*[f32(c) * a for c in image.colors], a, alpha="premultiplied")


def unpremultiply(image: Raster) -> Raster:
    if not image.has_alpha or image.alpha != "premultiplied":
        raise RasterError("unpremultiply needs premultiplied alpha")
    a = f32(image.channels[-1])
    return image.but(*[F.when(a > f32(F.lit(UNPREMULTIPLY_EPSILON)), f32(f32(c) / a)).otherwise(f32(F.lit(0.0))) for c in image.colors], a, alpha="straight")


def orientation(tensor: Raster, epsilon: float = 1e-12) -> tuple[Raster, Raster]:
    """Unit eigenvector of the smaller eigenvalue of (Jxx, Jxy, Jyy), and coherence. Two rasters on one frame."""
    xx, xy, yy = (c.cast("double") for c in tensor.channels)
    half, mid = (xx - yy) / 2, (xx + yy) / 2
    disc = F.sqrt(half * half + xy * xy)
    low = mid - disc
    # Of the two forms of the eigenvector the longer one is stable.
    u, v = F.when(half >= 0, xy).otherwise(low - yy), F.when(half >= 0, low - xx).otherwise(xy)
    norm = F.sqrt(u * u + v * v)
    flat = (disc <= epsilon) | (norm <= 0)
    turn = F.when((u < 0) | ((u == 0) & (v < 0)), -1.0).otherwise(1.0)
    ux, uy = (F.when(flat, 0.0).otherwise(turn * c / F.when(norm > 0, norm).otherwise(1.0)) for c in (u, v))
    coherence = F.when(mid <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.pow(disc / F.when(mid > 0, mid).otherwise(1.0), F.lit(2.0))))
    return tensor.but(ux, uy), tensor.but(coherence)


def materialize(image: Raster) -> Raster:
    """The same samples behind a lineage cut, in the folder for checkpoints."""
    return image.over(settle(image.table()), len(image.channels))
