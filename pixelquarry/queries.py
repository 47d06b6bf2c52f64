"""One query for each operator over rasters made of the driver's tables, each with its DuckDB twin where SQL can say it.

The events are a batch of rasters, 100 wide and 10 high: ``rid`` numbers them, so their number grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import filters, frequency, geometry, masks, paint, pointwise, reports, solvers, topology
from .plans.raster import KEYS, Raster, together
from .sources import generate, png

W, H = 100, 10
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TYPE = "CASE event_type WHEN 'purchase' THEN {0} WHEN 'error' THEN {1} WHEN 'view' THEN {2} WHEN 'click' THEN {3} ELSE {4} END"
_CHANNELS = {
    "c0": "least(value / 200, 1)",
    "c1": "(user_id % 256) / 255",
    "c2": "((event_id * 37) % 256) / 255",
    "c3": _TYPE.format(1.0, 0.0, 0.25, 0.5, 0.75),
    "m": _TYPE.format(1.0, 0.0, *["least(value / 200, 1)"] * 3),
    "b0": "least((event_id % 977) / 976, 1)",
}
_SELECT = ", ".join(f"CAST({e} AS FLOAT) AS {n}" for n, e in _CHANNELS.items())
EV = f"ev AS (SELECT CAST(event_id // 1000 AS BIGINT) AS rid, CAST((event_id % 1000) // 100 AS INT) AS y, CAST(event_id % 100 AS INT) AS x, {_SELECT} FROM events)"


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    keys = ["CAST(event_id DIV 1000 AS BIGINT) AS rid", "CAST((event_id % 1000) DIV 100 AS INT) AS y", "CAST(event_id % 100 AS INT) AS x"]
    return events.selectExpr(*keys, *[f"CAST({e} AS FLOAT) AS {n}" for n, e in _CHANNELS.items()])


class Scene:
    """The rasters that the queries start from, all on one frame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, f = spark, frame(spark, sf_dir)
        of = lambda *names, **more: Raster(f, tuple(F.col(n) for n in names), W, H, **more)
        self.rgba = of("c0", "c1", "c2", "c3", has_alpha=True)
        self.srgb = of("c0", "c1", "c2", "c3", has_alpha=True, color="srgb")
        self.other = of("c2", "b0", "c0", "m", has_alpha=True)
        self.gray, self.field, self.mask, self.mask2 = of("c0"), of("b0"), of("m"), of("c1")


def rounded(columns: list[str], digits: int = 5) -> list:
    return [(F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) for c in columns]


def show(raster: Raster, digits: int = 5) -> DataFrame:
    return raster.table().select(*KEYS, *rounded([f"c{i}" for i in range(len(raster.channels))], digits))


def _f(e: str) -> str:
    return f"CAST({e} AS FLOAT)"


def pixels(*exprs: str, source: str = "ev", where: str = "", x: str = "x", y: str = "y", ctes: str = EV, digits: int = 5) -> str:
    cs = ", ".join(f"round(CAST(CAST({e} AS FLOAT) AS DOUBLE), {digits}) + 0.0 AS c{i}" for i, e in enumerate(exprs))
    return f"WITH {ctes} SELECT rid, CAST({y} AS INT) AS y, CAST({x} AS INT) AS x, {cs} FROM {source} {where}"


def query(name: str, run: Callable[[Scene], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(Scene(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = sql


RGBA = ["c0", "c1", "c2", "c3"]
D = lambda c: f"CAST({c} AS DOUBLE)"

# Sources and sinks
query("image_create", lambda s: show(generate.create(s.spark, 40, 30, "rgba", [0.25, 0.5, 0.75, 1.0])),
      "SELECT CAST(0 AS BIGINT) AS rid, CAST(i // 40 AS INT) AS y, CAST(i % 40 AS INT) AS x, 0.25::DOUBLE AS c0, 0.5::DOUBLE AS c1, 0.75::DOUBLE AS c2, 1.0::DOUBLE AS c3 FROM range(1200) t(i)")




def _lattice_sql(name: str, nx: int, ny: int, seed: int) -> str:
    """Lattice values by 64-bit arithmetic on 128-bit integers, a step a table."""
    m, u = "18446744073709551616::UHUGEINT", "::UHUGEINT"
    parts = [f"{name}_0 AS (SELECT CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, xor({seed}{u}, (gx{u} * {0x9E3779B97F4A7C15}{u}) % {m}) AS z FROM range({nx}) a(gx), range({ny}) b(gy))"]
    n = 0
    for last in (False, True):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            parts.append(f"{name}_{n + 1} AS (SELECT gx, gy, (xor(z, z // {1 << shift}{u}) * {times}{u}) % {m} AS z FROM {name}_{n})")
            n += 1
        done = f"xor(z, z // {1 << 31}{u})"
        out = f"CAST({done} // {1 << 40}{u} AS DOUBLE) / {1 << 24} * 2 - 1 AS v" if last else f"xor({done}, (gy{u} * {0xC2B2AE3D27D4EB4F}{u}) % {m}) AS z"
        parts.append(f"{name}_{n + 1} AS (SELECT gx, gy, {out} FROM {name}_{n})")
        n += 1
    return ", ".join(parts) + f", {name} AS (SELECT * FROM {name}_{n})"


def _noise_sql(octaves: list[tuple[float, float, int]], w: int, h: int, digits: int = 4) -> str:
    """Octaves of (frequency, amplitude, lattice seed)."""
    ctes, joins, total = [f"px AS (SELECT CAST(i // {w} AS INT) AS y, CAST(i % {w} AS INT) AS x FROM range({w * h}) t(i))"], "px", []
    for k, (frequency, amplitude, seed) in enumerate(octaves):
        scale = frequency / generate.FREQUENCY_PIXELS
        ctes.append(_lattice_sql(f"n{k}", int(w * scale) + 3, int(h * scale) + 3, seed))
        fx, fy = f"((x + 0.5::DOUBLE) * {scale!r}::DOUBLE)", f"((y + 0.5::DOUBLE) * {scale!r}::DOUBLE)"
        for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
            joins += f" JOIN n{k} AS n{k}_{i}{j} ON n{k}_{i}{j}.gx = floor({fx}) + {i} AND n{k}_{i}{j}.gy = floor({fy}) + {j}"
        fade = lambda t: f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"
        tx, ty = fade(f"({fx} - floor({fx}))"), fade(f"({fy} - floor({fy}))")
        top, low = (f"((n{k}_1{j}.v - n{k}_0{j}.v) * {tx} + n{k}_0{j}.v)" for j in (0, 1))
        total.append(f"{amplitude!r}::DOUBLE * (({low} - {top}) * {ty} + {top})")
    scale = sum(a for _, a, _ in octaves)
    return f"WITH {', '.join(ctes)} SELECT CAST(0 AS BIGINT) AS rid, y, x, round(CAST(CAST(({' + '.join(total)}) / {scale!r}::DOUBLE AS FLOAT) AS DOUBLE), {digits}) + 0.0 AS c0 FROM {joins}"


query("field_noise", lambda s: show(generate.noise(s.spark, 48, 32, frequency=6.0, seed=11), 4), _noise_sql([(6.0, 1.0, 11)], 48, 32))
query("field_fbm", lambda s: show(generate.fbm(s.spark, 48, 32, frequency=3.0, seed=5, octaves=3), 4),
      _noise_sql([(3.0 * 2**o, 0.5**o, int(generate.mix64(np.uint64(5) ^ np.uint64(o + 1)))) for o in range(3)], 48, 32))
_Q = "CAST(floor(least(greatest(CAST({0} AS DOUBLE), 0), 1) * 255 + 0.5) AS INT)"
query("io_encode_image", lambda s: s.rgba.frame.select(*KEYS, *[png.quantized(c).alias(f"c{i}") for i, c in enumerate(s.rgba.channels)]),
      f"WITH {EV} SELECT rid, y, x, {', '.join(_Q.format(c) + f' AS c{i}' for i, c in enumerate(RGBA))} FROM ev")
query("io_decode_image", lambda s: png.decode_table(png.encode_images(s.rgba).select(F.col("rid").cast("string").alias("path"), F.col("png").alias("content")))
      .select(F.col("path").cast("long").alias("rid"), "y", "x", "ch", *rounded(["v"])),
      f"WITH {EV} " + " UNION ALL ".join(f"SELECT rid, y, x, {i} AS ch, round(CAST(CAST({_Q.format(c)} AS FLOAT) / CAST(255 AS FLOAT) AS DOUBLE), 5) + 0.0 AS v FROM ev" for i, c in enumerate(RGBA)))

# Pointwise
query("image_extract_channel", lambda s: show(pointwise.extract_channel(s.rgba, 1)), pixels("c1"))
query("image_assemble_channels", lambda s: show(pointwise.assemble_channels(s.gray, s.field, pointwise.extract_channel(geometry.flip(s.rgba, "horizontal"), 2))),
      f"WITH {EV} SELECT a.rid, a.y, a.x, round(a.c0::DOUBLE, 5) + 0.0 AS c0, round(a.b0::DOUBLE, 5) + 0.0 AS c1, round(b.c2::DOUBLE, 5) + 0.0 AS c2 FROM ev a JOIN ev b ON a.rid = b.rid AND a.y = b.y AND a.x = {W - 1} - b.x")
_DEC = lambda c: f"CASE WHEN {D(c)} <= 0.04045 THEN {D(c)} / 12.92 ELSE pow(({D(c)} + 0.055) / 1.055, 2.4) END"
_ENC = lambda c: f"CASE WHEN {D(c)} <= 0.0031308 THEN {D(c)} * 12.92 ELSE 1.055 * pow({D(c)}, 1 / 2.4::DOUBLE) - 0.055 END"
query("color_convert", lambda s: show(pointwise.convert(s.srgb, "srgb", "linear-srgb")), pixels(*[_DEC(c) for c in RGBA[:3]], "c3"))
query("color_convert_encode", lambda s: show(pointwise.convert(s.rgba, "linear-srgb", "srgb")), pixels(*[_ENC(c) for c in RGBA[:3]], "c3"))
_ADJ = f"adj AS (SELECT *, {D('c0')} * {2.0**0.5!r}::DOUBLE * 1.1::DOUBLE AS r, {D('c1')} * {2.0**0.5!r}::DOUBLE AS g, {D('c2')} * {2.0**0.5!r}::DOUBLE * {1 - 0.1!r}::DOUBLE AS b FROM ev), lum AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM adj)"
_ADJ_OUT = [_f(f"l + 1.25::DOUBLE * ({c} - l)") for c in "rgb"]
query("color_adjust", lambda s: show(pointwise.adjust(s.rgba, 0.5, 0.25, 0.1)), pixels(*_ADJ_OUT, "c3", source="lum", ctes=f"{EV}, {_ADJ}"))
query("color_adjust_masked", lambda s: show(pointwise.adjust(s.rgba, 0.5, 0.25, 0.1, s.mask)),
      pixels(*[f"{c} + {D('m')} * ({a} - {c})" for a, c in zip(_ADJ_OUT, RGBA, strict=False)], "c3", source="lum", ctes=f"{EV}, {_ADJ}"))
query("alpha_premultiply", lambda s: show(pointwise.premultiply(s.rgba)), pixels(*[f"{c} * c3" for c in RGBA[:3]], "c3"))
_PRE = f"pre AS (SELECT rid, y, x, {', '.join(f'{c} * c3 AS {c}' for c in RGBA[:3])}, c3 FROM ev)"
query("alpha_unpremultiply", lambda s: show(pointwise.unpremultiply(pointwise.premultiply(s.rgba))),
      pixels(*[f"CASE WHEN c3 > CAST(1e-6 AS FLOAT) THEN {c} / c3 ELSE CAST(0 AS FLOAT) END" for c in RGBA[:3]], "c3", source="pre", ctes=f"{EV}, {_PRE}"))


def _orient(s: Scene) -> DataFrame:
    tensor = Raster(s.rgba.frame, (F.col("c0"), F.col("b0") - F.lit(0.5).cast("float"), F.col("c1")), W, H)
    direction, coherence = pointwise.orientation(tensor)
    both = direction.but(*direction.channels, *coherence.channels)
    return show(both, 4)


_OR = f"""t AS (SELECT rid, y, x, {D('c0')} AS xx, CAST(b0 - CAST(0.5 AS FLOAT) AS DOUBLE) AS xy, {D('c1')} AS yy FROM ev),
u AS (SELECT *, (xx - yy) / 2 AS half, (xx + yy) / 2 AS mid FROM t), d AS (SELECT *, sqrt(half * half + xy * xy) AS disc FROM u),
e AS (SELECT *, CASE WHEN half >= 0 THEN xy ELSE mid - disc - yy END AS p, CASE WHEN half >= 0 THEN mid - disc - xx ELSE xy END AS q FROM d),
n AS (SELECT *, sqrt(p * p + q * q) AS norm, CASE WHEN p < 0 OR (p = 0 AND q < 0) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS turn FROM e)"""
_FLAT = "CASE WHEN disc <= 1e-12::DOUBLE OR norm <= 0 THEN 0.0::DOUBLE ELSE turn * {0} / norm END"
query("field_orientation", _orient, pixels(_FLAT.format("p"), _FLAT.format("q"), "CASE WHEN mid <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, pow(disc / mid, 2)) END", source="n", ctes=f"{EV}, {_OR}", digits=4))
query("debug_materialize", lambda s: show(pointwise.materialize(s.rgba)), pixels(*RGBA))

# Geometry
query("image_crop", lambda s: show(geometry.crop(s.rgba, 10, 2, 60, 9)), pixels(*RGBA, x="x - 10", y="y - 2", where="WHERE x >= 10 AND x < 60 AND y >= 2 AND y < 9"))


def _pad_sql(mode: str, left: int, right: int, top: int, bottom: int, value: float = 0.0) -> str:
    def at(v: str, n: int) -> str:
        if mode == "constant":
            return v
        if mode == "clamp":
            return f"least(greatest({v}, 0), {n - 1})"
        if mode == "wrap":
            return f"((({v}) % {n}) + {n}) % {n}"
        p = f"((({v}) % {2 * n - 2}) + {2 * n - 2}) % {2 * n - 2}"
        return f"least({p}, {2 * n - 2} - ({p}))"

    cells = f"g AS (SELECT r.rid, a.i AS x, b.j AS y, {at(f'a.i - {left}', W)} AS sx, {at(f'b.j - {top}', H)} AS sy FROM (SELECT DISTINCT rid FROM ev) r, range({W + left + right}) a(i), range({H + top + bottom}) b(j))"
    out = ", ".join(f"round(CAST(coalesce(e.{c}, CAST({value} AS FLOAT)) AS DOUBLE), 5) + 0.0 AS {c}" for c in RGBA)
    return f"WITH {EV}, {cells} SELECT g.rid, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, {out} FROM g LEFT JOIN ev e ON e.rid = g.rid AND e.x = g.sx AND e.y = g.sy"


for _mode, _sides in (("constant", (3, 2, 1, 4)), ("clamp", (3, 2, 1, 4)), ("mirror", (13, 2, 4, 3)), ("wrap", (5, 7, 2, 2)), ("clamp_crop", (-10, -5, -1, 0))):
    _m = _mode.split("_")[0]
    query(f"image_pad_{_mode}", lambda s, m=_m, a=_sides: show(geometry.pad(s.rgba, *a, mode=m, value=0.5)), _pad_sql(_m, *_sides, value=0.5))
for _axis, _x, _y in (("horizontal", f"{W - 1} - x", "y"), ("vertical", "x", f"{H - 1} - y"), ("both", f"{W - 1} - x", f"{H - 1} - y")):
    query(f"image_flip_{_axis}", lambda s, a=_axis: show(geometry.flip(s.rgba, a)), pixels(*RGBA, x=_x, y=_y))
for _turns, _x, _y in ((1, f"{H - 1} - y", "x"), (2, f"{W - 1} - x", f"{H - 1} - y"), (3, "y", f"{W - 1} - x")):
    query(f"image_rotate90_{_turns}", lambda s, t=_turns: show(geometry.rotate90(s.rgba, t)), pixels(*RGBA, x=_x, y=_y))


def _passes(source: str, target: str, columns: list[str], xt: str, yt: str) -> str:
    """Two tap passes in SQL; ``xt`` and ``yt`` are table expressions of (o, s, w)."""
    sums = ", ".join(f"CAST(sum(CAST({c} AS DOUBLE) * w) AS FLOAT) AS {c}" for c in columns)
    return f"{target}_x AS (SELECT rid, y, o AS x, {sums} FROM {source} JOIN ({xt}) t ON x = s GROUP BY rid, y, o), {target} AS (SELECT rid, o AS y, x, {sums} FROM {target}_x JOIN ({yt}) t ON y = s GROUP BY rid, x, o)"


def _values(taps: list[tuple[int, int, float]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({o}, {s}, {w!r}::DOUBLE)" for o, s, w in taps) + ") v(o, s, w)"


def _gauss(n: int, sigma: float) -> str:
    """Clamped Gaussian taps worked out in SQL."""
    r = -(-3 * sigma // 1)
    raw = f"SELECT CAST(o AS INT) AS o, least(greatest(o + k, 0), {n - 1}) AS s, exp(-(k * k) / {2 * sigma * sigma!r}::DOUBLE) / (SELECT sum(exp(-(j * j) / {2 * sigma * sigma!r}::DOUBLE)) FROM range({int(-r)}, {int(r) + 1}) z(j)) AS w FROM range({n}) a(o), range({int(-r)}, {int(r) + 1}) b(k)"
    return f"SELECT o, s, sum(w) AS w FROM ({raw}) GROUP BY o, s"


def _bilinear(n_in: int, n_out: int) -> str:
    at = f"((o + 0.5::DOUBLE) * {n_in} / {n_out} - 0.5::DOUBLE)"
    raw = f"SELECT CAST(o AS INT) AS o, least(greatest(CAST(floor({at}) AS INT) + k, 0), {n_in - 1}) AS s, CASE k WHEN 0 THEN 1 - ({at} - floor({at})) ELSE {at} - floor({at}) END AS w FROM range({n_out}) a(o), range(2) b(k)"
    return f"SELECT o, s, sum(w) AS w FROM ({raw}) GROUP BY o, s"


def _nearest(n_in: int, n_out: int) -> str:
    return f"SELECT CAST(o AS INT) AS o, least(greatest(CAST(floor((o + 0.5::DOUBLE) * {n_in} / {n_out} - 0.5::DOUBLE + 0.5::DOUBLE) AS INT), 0), {n_in - 1}) AS s, 1.0::DOUBLE AS w FROM range({n_out}) a(o)"


query("image_resize_bilinear", lambda s: show(geometry.resize(s.rgba, 61, 7, "bilinear"), 4), pixels(*RGBA, source="z", ctes=f"{EV}, " + _passes("ev", "z", RGBA, _bilinear(W, 61), _bilinear(H, 7)), digits=4))
query("image_resize_nearest", lambda s: show(geometry.resize(s.rgba, 130, 15, "nearest")), pixels(*RGBA, source="z", ctes=f"{EV}, " + _passes("ev", "z", RGBA, _nearest(W, 130), _nearest(H, 15))))
for _kind in ("bicubic", "lanczos3"):
    query(f"image_resize_{_kind}", lambda s, k=_kind: show(geometry.resize(s.gray, 73, 8, k), 4),
          pixels("c0", source="z", ctes=f"{EV}, " + _passes("ev", "z", ["c0"], _values(geometry.resize_taps(W, 73, _kind)), _values(geometry.resize_taps(H, 8, _kind))), digits=4))
_WARP = f"""p AS (SELECT rid, y, x, x + CAST(c1 * 4 AS DOUBLE) AS fx, y + CAST(c2 * 2 AS DOUBLE) AS fy FROM ev),
t AS (SELECT rid, y, x, CAST(floor(fx) AS INT) + i AS tx, CAST(floor(fy) AS INT) + j AS ty, (CASE i WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) * (CASE j WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) AS w FROM p, range(2) a(i), range(2) b(j)),
z AS (SELECT t.rid, t.y, t.x, sum(CAST(e.c0 AS DOUBLE) * w) AS c0 FROM t JOIN ev e ON e.rid = t.rid AND e.x = least(greatest(tx, 0), {W - 1}) AND e.y = least(greatest(ty, 0), {H - 1}) GROUP BY t.rid, t.y, t.x)"""
query("field_domain_warp", lambda s: show(geometry.domain_warp(s.gray, Raster(s.rgba.frame, (F.col("c1") * F.lit(4).cast("float"), F.col("c2") * F.lit(2).cast("float")), W, H)), 4), pixels("c0", source="z", ctes=f"{EV}, {_WARP}", digits=4))

# Masks and distance fields
query("mask_empty", lambda s: show(masks.empty(s.rgba)), pixels("0"))
query("mask_full", lambda s: show(masks.full(s.rgba)), pixels("1"))
_side = lambda a, lo, hi: f"greatest(least({hi}::DOUBLE, {a} + 1) - greatest({lo}::DOUBLE, {a}), 0)"
query("mask_rect", lambda s: show(masks.rect(s.rgba, 10.25, 1.5, 70.75, 8.125)), pixels(f"{_side('x', 10.25, 70.75)} * {_side('y', 1.5, 8.125)}"))
_ELL = """el AS (SELECT *, x + 0.5::DOUBLE - 48.0::DOUBLE AS u, y + 0.5::DOUBLE - 5.0::DOUBLE AS v FROM ev), e2 AS (SELECT *, sqrt((u / 30.0::DOUBLE) * (u / 30.0::DOUBLE) + (v / 4.0::DOUBLE) * (v / 4.0::DOUBLE)) AS f, sqrt((u / 900.0::DOUBLE) * (u / 900.0::DOUBLE) + (v / 16.0::DOUBLE) * (v / 16.0::DOUBLE)) AS g FROM el),
e3 AS (SELECT *, least(greatest(((f - 1) * f / g + 0.5::DOUBLE) / 1.0::DOUBLE, 0), 1) AS t FROM e2)"""
query("mask_ellipse", lambda s: show(masks.ellipse(s.rgba, 48.0, 5.0, 30.0, 4.0)), pixels("1 - t * t * (3 - 2 * t)", source="e3", ctes=f"{EV}, {_ELL}"))
_POINTS = [(5.0, 1.0), (90.0, 0.5), (60.0, 9.5), (40.0, 3.0), (12.0, 9.0)]
_EDGES = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(_POINTS, _POINTS[1:] + _POINTS[:1], strict=True))
_POLY = f"""sub AS (SELECT x + (i + 0.5::DOUBLE) / 4 AS px, y + (j + 0.5::DOUBLE) / 4 AS py, x, y FROM range({W}) a(x), range({H}) b(y), range(4) c(i), range(4) d(j)),
turn AS (SELECT x, y, px, py, sum(CASE WHEN (ay <= py) <> (by_ <= py) AND px < ax + (py - ay) / (by_ - ay) * (bx - ax) THEN CASE WHEN by_ > ay THEN 1 ELSE -1 END ELSE 0 END) AS n FROM sub, (VALUES {_EDGES}) e(ax, ay, bx, by_) GROUP BY ALL),
cov AS (SELECT x AS cx, y AS cy, count_if({{0}}) / 16.0::DOUBLE AS cov FROM turn GROUP BY x, y)"""
query("mask_polygon", lambda s: show(masks.polygon(s.rgba, _POINTS)), pixels("cov", source="ev JOIN cov ON x = cx AND y = cy", ctes=f"{EV}, {_POLY.format('n <> 0')}"))
query("mask_polygon_evenodd", lambda s: show(masks.polygon(s.rgba, _POINTS, "even-odd")), pixels("cov", source="ev JOIN cov ON x = cx AND y = cy", ctes=f"{EV}, {_POLY.format('abs(n) % 2 = 1')}"))
query("mask_invert", lambda s: show(masks.invert(s.mask)), pixels("CAST(1 AS FLOAT) - m"))
query("mask_union", lambda s: show(masks.union(s.mask, s.mask2)), pixels("greatest(m, c1)"))
query("mask_intersect", lambda s: show(masks.intersect(s.mask, s.mask2)), pixels("least(m, c1)"))
query("mask_subtract", lambda s: show(masks.subtract(s.mask, s.mask2)), pixels("least(m, CAST(1 AS FLOAT) - c1)"))


def _sdf(column: str, threshold: float, name: str) -> str:
    """Brute force: all pairs of pixels of a raster."""
    return f"""{name} AS (SELECT a.rid, a.y, a.x, CASE WHEN count_if(b.{column} >= {threshold}) = 0 THEN 'Infinity'::DOUBLE WHEN count_if(b.{column} < {threshold}) = 0 THEN '-Infinity'::DOUBLE
    ELSE sqrt(CAST(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) FILTER (b.{column} >= {threshold}) AS DOUBLE)) - sqrt(CAST(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) FILTER (b.{column} < {threshold}) AS DOUBLE)) END AS phi
    FROM ev a JOIN ev b ON a.rid = b.rid GROUP BY a.rid, a.y, a.x)"""


_S1, _S2 = _sdf("m", 0.5, "s1"), _sdf("c1", 0.75, "s2")
_BOTH = f"{EV}, {_S1}, {_S2}, two AS (SELECT s1.rid, s1.y, s1.x, CAST(s1.phi AS FLOAT) AS p, CAST(s2.phi AS FLOAT) AS q FROM s1 JOIN s2 USING (rid, y, x))"
_sdfs = lambda s: (masks.mask_to_sdf(s.mask), masks.mask_to_sdf(s.mask2, 0.75))
query("mask_to_sdf", lambda s: show(masks.mask_to_sdf(s.mask)), pixels("phi", source="s1", ctes=f"{EV}, {_S1}"))
query("sdf_union", lambda s: show(masks.sdf_union(*_sdfs(s))), pixels("least(p, q)", source="two", ctes=_BOTH))
query("sdf_intersect", lambda s: show(masks.sdf_intersect(*_sdfs(s))), pixels("greatest(p, q)", source="two", ctes=_BOTH))
query("sdf_subtract", lambda s: show(masks.sdf_subtract(*_sdfs(s))), pixels("greatest(p, -q)", source="two", ctes=_BOTH))
query("sdf_offset", lambda s: show(masks.sdf_offset(masks.mask_to_sdf(s.mask), 1.5)), pixels("CAST(phi AS FLOAT) - CAST(1.5 AS FLOAT)", source="s1", ctes=f"{EV}, {_S1}"))
_STEP = lambda phi, h: f"(SELECT t * t * (3 - 2 * t) FROM (SELECT least(greatest(({h}::DOUBLE - {phi}) / {2 * h}::DOUBLE, 0), 1) AS t))"
query("sdf_to_mask", lambda s: show(masks.sdf_to_mask(masks.mask_to_sdf(s.mask), 2.0)), pixels(_STEP("CAST(CAST(phi AS FLOAT) AS DOUBLE)", 2.0), source="s1", ctes=f"{EV}, {_S1}"))
query("mask_grow", lambda s: show(masks.grow(s.mask, 1.25)), pixels("CASE WHEN CAST(phi AS FLOAT) - CAST(1.25 AS FLOAT) <= 0 THEN 1 ELSE 0 END", source="s1", ctes=f"{EV}, {_S1}"))
query("mask_shrink", lambda s: show(masks.shrink(s.mask, 0.5)), pixels("CASE WHEN CAST(phi AS FLOAT) + CAST(0.5 AS FLOAT) <= 0 THEN 1 ELSE 0 END", source="s1", ctes=f"{EV}, {_S1}"))
query("mask_feather", lambda s: show(masks.feather(s.mask, 3.0)), pixels(_STEP("CAST(CAST(phi AS FLOAT) AS DOUBLE)", 3.0), source="s1", ctes=f"{EV}, {_S1}"))

# Paint and composite
_BETWEEN = lambda b, t: f"CASE WHEN m = 0 THEN {b} WHEN m = 1 THEN {t} ELSE {b} + m * ({t} - {b}) END"
_OTHER = ["c2", "b0", "c0", "m"]
query("paint_fill", lambda s: show(paint.fill(s.rgba, s.mask, [0.2, 0.4, 0.6, 1.0])), pixels(*[_BETWEEN(c, _f(str(v))) for c, v in zip(RGBA, (0.2, 0.4, 0.6, 1.0), strict=True)]))
query("composite_masked_replace", lambda s: show(paint.masked_replace(s.other, s.rgba, s.mask)), pixels(*[_BETWEEN(c, o) for c, o in zip(RGBA, _OTHER, strict=True)]))


def _over(s: Scene) -> DataFrame:
    return show(paint.over(pointwise.premultiply(s.rgba), pointwise.premultiply(s.other)))


query("composite_over", _over, pixels(*[f"{c} * c3 + ({o} * m) * (CAST(1 AS FLOAT) - c3)" for c, o in zip(RGBA[:3], _OTHER, strict=False)], "c3 + m * (CAST(1 AS FLOAT) - c3)"))
_MODES = {"normal": "{0}", "add": "{0} + {1}", "subtract": "{1} - {0}", "multiply": "{0} * {1}", "screen": "{0} + {1} - {0} * {1}", "darken": "least({0}, {1})", "lighten": "greatest({0}, {1})", "difference": "abs({0} - {1})"}
for _mode, _e in _MODES.items():
    query(f"composite_blend_{_mode}", lambda s, m=_mode: show(paint.blend(s.other, s.rgba, s.mask2, m, 0.75)),
          pixels(*[f"CASE WHEN CAST(0.75 AS FLOAT) * c1 = 0 THEN {d} ELSE {d} + (CAST(0.75 AS FLOAT) * c1) * (({_e.format(o, d)}) - {d}) END" for o, d in zip(_OTHER, RGBA, strict=True)]))
_STOPS = [(0.0, [1.0, 0.0, 0.25, 1.0]), (0.4, [0.5, 0.75, 0.1, 0.5]), (1.0, [0.0, 0.3, 0.9, 1.0])]


def _ladder(i: int) -> str:
    parts = [f"WHEN t < {q}::DOUBLE THEN CASE WHEN t = {p}::DOUBLE THEN {a[i]}::DOUBLE ELSE {a[i]}::DOUBLE + (t - {p}::DOUBLE) / {q - p!r}::DOUBLE * {b[i] - a[i]!r}::DOUBLE END" for (p, a), (q, b) in zip(_STOPS, _STOPS[1:], strict=False)]
    return "CASE " + " ".join(parts) + f" ELSE {_STOPS[-1][1][i]}::DOUBLE END"


_LIN = "g AS (SELECT *, least(greatest(((x + 0.5::DOUBLE - 5) * 85.0::DOUBLE + (y + 0.5::DOUBLE - 1) * 7.0::DOUBLE) / 7274.0::DOUBLE, 0), 1) AS t FROM ev)"
_RAD = "g AS (SELECT *, least(greatest(sqrt((x + 0.5::DOUBLE - 40) * (x + 0.5::DOUBLE - 40) + (y + 0.5::DOUBLE - 5) * (y + 0.5::DOUBLE - 5)) / 35.0::DOUBLE, 0), 1) AS t FROM ev)"
query("paint_linear_gradient", lambda s: show(paint.linear_gradient(s.rgba, (5.0, 1.0), (90.0, 8.0), _STOPS)), pixels(*[_ladder(i) for i in range(4)], source="g", ctes=f"{EV}, {_LIN}"))
query("paint_radial_gradient", lambda s: show(paint.radial_gradient(s.rgba, (40.0, 5.0), 35.0, _STOPS)), pixels(*[_ladder(i) for i in range(4)], source="g", ctes=f"{EV}, {_RAD}"))
_SPLATS = [
    {"center_px": [30.0, 4.0], "sigma_px": [8.0, 2.0], "angle_rad": 0.0, "color": [1.0, 0.5, 0.25, 0.8], "opacity": 0.9, "blend": "normal"},
    {"center_px": [60.0, 6.0], "sigma_px": [12.0, 3.0], "angle_rad": 0.0, "color": [0.2, 0.9, 0.4, 0.6], "opacity": 0.7, "blend": "multiply"},
    {"center_px": [45.0, 5.0], "sigma_px": [5.0, 5.0], "angle_rad": 0.0, "color": [0.3, 0.3, 0.9, 0.5], "opacity": 1.0, "blend": "screen"},
]


def _splat_sql() -> str:
    ctes, last = f"{EV}, p0 AS (SELECT rid, y, x, {', '.join(f'CAST({c} AS DOUBLE) AS d{i}' for i, c in enumerate(RGBA))} FROM ev)", "p0"
    for k, s in enumerate(_SPLATS, 1):
        (cx, cy), (sx, sy), col = s["center_px"], s["sigma_px"], s["color"]
        u, v = f"((x + 0.5::DOUBLE - {cx}::DOUBLE) / {sx}::DOUBLE)", f"((y + 0.5::DOUBLE - {cy}::DOUBLE) / {sy}::DOUBLE)"
        a = f"({col[3]}::DOUBLE * ({s['opacity']}::DOUBLE * exp(-0.5::DOUBLE * ({u} * {u} + {v} * {v}))))"
        src = [f"{c}::DOUBLE * {a}" for c in col[:3]] + [a]
        if s["blend"] == "normal":
            new = [f"d{i} * (1 - {a}) + {src[i]}" for i in range(4)]
        elif s["blend"] == "multiply":
            new = [f"d{i} * (1 - {a}) + d{i} * {col[i]}::DOUBLE * {a}" for i in range(3)] + [f"d3 * (1 - {a}) + {a}"]
        else:
            new = [f"d{i} + {src[i]} - d{i} * ({src[i]})" for i in range(4)]
        ctes += f", p{k} AS (SELECT rid, y, x, {', '.join(f'{e} AS d{i}' for i, e in enumerate(new))} FROM {last})"
        last = f"p{k}"
    return pixels("d0", "d1", "d2", "d3", source=last, ctes=ctes, digits=4)


query("paint_gaussian_splats", lambda s: show(paint.gaussian_splats(s.rgba, _SPLATS), 4), _splat_sql())

# Filters
_K = [0.0, -1.0, 0.5, -1.0, 5.0, -1.0, 0.25, -1.0, 0.0]
_KV = ", ".join(f"({i % 3}, {i // 3}, {w}::DOUBLE)" for i, w in enumerate(_K) if w)


def _conv_sql(at: Callable[[str, int], str], where: str = "") -> str:
    return pixels("v", source="z", digits=4, ctes=f"{EV}, o AS (SELECT rid, y, x, {at('x + kx - 1', W)} AS sx, {at('y + ky - 1', H)} AS sy, w FROM ev, (VALUES {_KV}) k(kx, ky, w) {where}), z AS (SELECT o.rid, o.y, o.x, sum(CAST(e.c0 AS DOUBLE) * w) AS v FROM o JOIN ev e ON e.rid = o.rid AND e.x = o.sx AND e.y = o.sy GROUP BY o.rid, o.y, o.x)")


query("filter_convolve", lambda s: show(filters.convolve(s.gray, 3, 3, _K), 4), _conv_sql(lambda v, n: f"least(greatest({v}, 0), {n - 1})"))
_ONE = [0.0, 0.0, 0.0, 1.5, 0.0, 0.0, 0.0, 0.0, -0.5]


def _conv_outside_sql(weights: list[float], value: float, where: str = "true", shift: int = 0) -> str:
    """All taps of all pixels; what lies outside is ``value``."""
    taps = ", ".join(f"({i % 3}, {i // 3}, {w}::DOUBLE)" for i, w in enumerate(weights))
    grid = f"o AS (SELECT rid, y, x, x + kx - 1 AS sx, y + ky - 1 AS sy, w FROM ev, (VALUES {taps}) k(kx, ky, w) WHERE {where})"
    return pixels("v", source="z", digits=4, ctes=f"{EV}, {grid}, z AS (SELECT o.rid, o.y - {shift} AS y, o.x - {shift} AS x, sum(coalesce(CAST(e.c0 AS DOUBLE), {value}::DOUBLE) * w) AS v FROM o LEFT JOIN ev e ON e.rid = o.rid AND e.x = o.sx AND e.y = o.sy GROUP BY o.rid, o.y, o.x)")


query("filter_convolve_constant", lambda s: show(filters.convolve(s.gray, 3, 3, _ONE, mode="constant", value=0.25), 4), _conv_outside_sql(_ONE, 0.25))
query("filter_convolve_transparent", lambda s: show(filters.convolve(s.gray, 3, 3, _ONE, mode="transparent"), 4), _conv_outside_sql(_ONE, 0.0))
query("filter_convolve_zero", lambda s: show(filters.convolve(s.gray, 3, 3, [0.0] * 9), 4), _conv_outside_sql([0.0] * 9, 0.0))
query("filter_convolve_valid", lambda s: show(filters.convolve(s.gray, 3, 3, _K, mode="valid"), 4), _conv_outside_sql(_K, 0.0, f"x BETWEEN 1 AND {W - 2} AND y BETWEEN 1 AND {H - 2}", 1))
query("filter_convolve_mirror", lambda s: show(filters.convolve(s.gray, 3, 3, _K, mode="mirror"), 4), _conv_sql(lambda v, n: f"({n - 1} - abs({n - 1} - abs({v})))"))
query("filter_convolve_wrap", lambda s: show(filters.convolve(s.gray, 3, 3, _K, mode="wrap"), 4), _conv_sql(lambda v, n: f"({v} + {n}) % {n}"))
_BLUR = _passes("ev", "z", RGBA, _gauss(W, 1.2), _gauss(H, 1.2))
query("filter_gaussian_blur", lambda s: show(filters.gaussian_blur(s.rgba, 1.2), 4), pixels(*RGBA, source="z", ctes=f"{EV}, {_BLUR}", digits=4))
_BIL = f"""o AS (SELECT rid, y, x, c0 AS p0, c1 AS p1, kx, ky, least(greatest(x + kx, 0), {W - 1}) AS sx, least(greatest(y + ky, 0), {H - 1}) AS sy FROM ev, range(-3, 4) a(kx), range(-3, 4) b(ky)),
q AS (SELECT o.rid, o.y, o.x, CAST(e.c0 AS DOUBLE) AS q0, CAST(e.c1 AS DOUBLE) AS q1, exp(-CAST(kx * kx + ky * ky AS DOUBLE) / 2.0::DOUBLE) * exp(-((CAST(p0 AS DOUBLE) - e.c0) * (CAST(p0 AS DOUBLE) - e.c0) + (CAST(p1 AS DOUBLE) - e.c1) * (CAST(p1 AS DOUBLE) - e.c1)) / {2 * 0.3**2!r}::DOUBLE) AS w FROM o JOIN ev e ON e.rid = o.rid AND e.x = o.sx AND e.y = o.sy),
z AS (SELECT rid, y, x, sum(q0 * w) / sum(w) AS v0, sum(q1 * w) / sum(w) AS v1 FROM q GROUP BY rid, y, x)"""
query("filter_bilateral", lambda s: show(filters.bilateral(Raster(s.rgba.frame, s.rgba.channels[:2], W, H), 1.0, 0.3), 4), pixels("v0", "v1", source="z", ctes=f"{EV}, {_BIL}", digits=4))


def _box_sql(source: str, target: str, names: list[str], keep: str) -> str:
    near = lambda a, b, t, s: f"{t} AS (SELECT a.rid, a.y, a.x, {', '.join(f'avg(b.{n}) AS {n}' for n in names)}{''.join(f', any_value(a.{k}) AS {k}' for k in keep.split())} FROM {s} a JOIN {s} b ON a.rid = b.rid AND a.{a} = b.{a} AND abs(a.{b} - b.{b}) <= 2 GROUP BY a.rid, a.y, a.x)"
    return near("y", "x", f"{target}_x", source) + ", " + near("x", "y", target, f"{target}_x")


_GUI = f"""g0 AS (SELECT rid, y, x, CAST(b0 AS DOUBLE) AS g, CAST(b0 AS DOUBLE) AS mg, CAST(c0 AS DOUBLE) AS mp, CAST(b0 AS DOUBLE) * b0 AS gg, CAST(b0 AS DOUBLE) * c0 AS gp FROM ev), {_box_sql('g0', 'g1', ['mg', 'mp', 'gg', 'gp'], 'g')},
g2 AS (SELECT rid, y, x, g, CASE WHEN gg - mg * mg + 0.01::DOUBLE <= 0 THEN 0 ELSE (gp - mg * mp) / (gg - mg * mg + 0.01::DOUBLE) END AS a, mp, mg FROM g1), g3 AS (SELECT rid, y, x, g, a, mp - a * mg AS b FROM g2), {_box_sql('g3', 'g4', ['a', 'b'], 'g')}"""
query("filter_guided", lambda s: show(filters.guided(s.gray, s.field, 2, 0.01), 4), pixels("a * g + b", source="g4", ctes=f"{EV}, {_GUI}", digits=4))
_TEN = f"""d AS (SELECT rid, y, x, (CAST(coalesce(lead(c0) OVER (PARTITION BY rid, y ORDER BY x), c0) AS DOUBLE) - coalesce(lag(c0) OVER (PARTITION BY rid, y ORDER BY x), c0)) / 2 AS gx, (CAST(coalesce(lead(c0) OVER (PARTITION BY rid, x ORDER BY y), c0) AS DOUBLE) - coalesce(lag(c0) OVER (PARTITION BY rid, x ORDER BY y), c0)) / 2 AS gy FROM ev),
j AS (SELECT rid, y, x, CAST(gx * gx AS FLOAT) AS c0, CAST(gx * gy AS FLOAT) AS c1, CAST(gy * gy AS FLOAT) AS c2 FROM d), """ + _passes("j", "z", ["c0", "c1", "c2"], _gauss(W, 1.5), _gauss(H, 1.5))
query("filter_structure_tensor", lambda s: show(filters.structure_tensor(s.gray, 0.0, 1.5), 4), pixels("c0", "c1", "c2", source="z", ctes=f"{EV}, {_TEN}", digits=4))

# Frequency
_PYR = f"l0 AS (SELECT rid, y, x, c0 FROM ev), {_passes('l0', 'b0_', ['c0'], _gauss(W, 1.0), _gauss(H, 1.0))}, l1 AS (SELECT rid, y // 2 AS y, x // 2 AS x, c0 FROM b0_ WHERE x % 2 = 0 AND y % 2 = 0), {_passes('l1', 'b1_', ['c0'], _gauss(50, 1.0), _gauss(5, 1.0))}, l2 AS (SELECT rid, y // 2 AS y, x // 2 AS x, c0 FROM b1_ WHERE x % 2 = 0 AND y % 2 = 0 AND y < 4)"
_UP = lambda f, c, w, h: f"SELECT f.rid, f.y, f.x, CAST(f.c0 - c.c0 AS FLOAT) AS c0 FROM {f} f JOIN {c} c ON f.rid = c.rid AND c.x = least(f.x // 2, {w - 1}) AND c.y = least(f.y // 2, {h - 1})"
_LAP = f"{_PYR}, d0 AS ({_UP('l0', 'l1', 50, 5)}), d1 AS ({_UP('l1', 'l2', 25, 2)})"
_LEVELS = lambda ts: " UNION ALL ".join(f"SELECT {i} AS level, rid, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(CAST(c0 AS DOUBLE), 4) + 0.0 AS c0 FROM {t}" for i, t in enumerate(ts))
query("frequency_gaussian_pyramid", lambda s: frequency.levels_table(frequency.gaussian_pyramid(s.gray, 3)).select("level", *KEYS, *rounded(["c0"], 4)), f"WITH {EV}, {_PYR} " + _LEVELS(["l0", "l1", "l2"]))
query("frequency_laplacian_split", lambda s: frequency.levels_table(frequency.laplacian_split(s.gray, 3)).select("level", *KEYS, *rounded(["c0"], 4)), f"WITH {EV}, {_LAP} " + _LEVELS(["d0", "d1", "l2"]))

query("frequency_recombine", lambda s: show(frequency.recombine(frequency.laplacian_split(s.gray, 3))), pixels("c0"))
_ANG = f"2 * pi() * (CAST((kx * x) % {W} AS DOUBLE) / {W} + CAST((ky * y) % {H} AS DOUBLE) / {H})"
_DFT = f"sp AS (SELECT rid, CAST(ky AS INT) AS ky, CAST(kx AS INT) AS kx, sum(CAST(c0 AS DOUBLE) * cos({_ANG})) AS re, -sum(CAST(c0 AS DOUBLE) * sin({_ANG})) AS im FROM ev, range({W}) a(kx), range({H}) b(ky) GROUP BY rid, ky, kx)"
query("frequency_fft2", lambda s: frequency.fft2(s.gray).select("rid", "ky", "kx", *rounded(["re_0", "im_0"], 2)), f"WITH {EV}, {_DFT} SELECT rid, ky, kx, round(CAST(CAST(re AS FLOAT) AS DOUBLE), 2) + 0.0 AS re_0, round(CAST(CAST(im AS FLOAT) AS DOUBLE), 2) + 0.0 AS im_0 FROM sp")
query("frequency_ifft2", lambda s: show(frequency.ifft2(frequency.fft2(s.gray), s.gray)), pixels("c0"))
query("frequency_bandpass", lambda s: show(frequency.bandpass(s.gray, 0.05, 0.3), 3))

# Topology and solvers
_NEAR = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1"
_CC = f"RECURSIVE {EV}, f AS (SELECT rid, y, x, y * {W} + x AS p FROM ev WHERE m >= 0.5), r AS (SELECT rid, p, y, x, p AS q FROM f UNION SELECT b.rid, b.p, b.y, b.x, a.q FROM r a JOIN f b ON a.rid = b.rid AND {_NEAR}), c AS (SELECT rid, y, x, min(q) AS root FROM r GROUP BY rid, y, x)"
query("mask_connected_components", lambda s: topology.connected_components(s.mask)[0],
      f"WITH {_CC}, k AS (SELECT rid, root, row_number() OVER (PARTITION BY rid ORDER BY root) AS n FROM (SELECT DISTINCT rid, root FROM c)) SELECT ev.rid, ev.y, ev.x, CAST(coalesce(k.n, 0) AS BIGINT) AS label FROM ev LEFT JOIN c ON c.rid = ev.rid AND c.y = ev.y AND c.x = ev.x LEFT JOIN k ON k.rid = c.rid AND k.root = c.root")
query("mask_remove_components", lambda s: show(topology.remove_components(s.mask, 4)),
      f"WITH {_CC}, k AS (SELECT rid, root, count(*) AS n FROM c GROUP BY rid, root) SELECT ev.rid, ev.y, ev.x, CASE WHEN k.n >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c0 FROM ev LEFT JOIN c ON c.rid = ev.rid AND c.y = ev.y AND c.x = ev.x LEFT JOIN k ON k.rid = c.rid AND k.root = c.root")
_HOLES = f"RECURSIVE {EV}, g AS (SELECT rid, y, x FROM ev WHERE m < 0.5), r AS (SELECT rid, y, x FROM g WHERE x = 0 OR y = 0 OR x = {W - 1} OR y = {H - 1} UNION SELECT b.rid, b.y, b.x FROM r a JOIN g b ON a.rid = b.rid AND abs(a.x - b.x) + abs(a.y - b.y) = 1)"
query("mask_fill_holes", lambda s: show(topology.fill_holes(s.mask, 4)), f"WITH {_HOLES} SELECT ev.rid, ev.y, ev.x, CASE WHEN r.x IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c0 FROM ev LEFT JOIN r ON r.rid = ev.rid AND r.y = ev.y AND r.x = ev.x")

def _near(c: str, torus: bool = False, edge: bool = False) -> str:
    """The four neighbours' sum of ``c`` in the windows ``wx`` and ``wy``; over the border the other side, the own sample, or null."""
    def side(step: str, w: str) -> str:
        other = f"{'last' if step == 'lag' else 'first'}_value({c}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" if torus else c
        return f"coalesce({step}({c}) OVER {w}, {other})" if torus or edge else f"{step}({c}) OVER {w}"

    return " + ".join(side(step, w) for w in ("wy", "wx") for step in ("lag", "lead"))


def _grey_scott_sql(steps: int, seed: int, du: float = 0.16, dv: float = 0.08, feed: float = 0.06, kill: float = 0.062) -> str:
    """One raster step by step; it is the same for all of the batch."""
    m, u = "18446744073709551616::UHUGEINT", "::UHUGEINT"
    mixed, ctes = f"xor({seed}{u}, ((x{u} * 4294967296{u} + y{u}) * {0x9E3779B97F4A7C15}{u}) % {m})", []
    for k, (shift, times) in enumerate(((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))):
        ctes.append(f"j{k} AS (SELECT y, x, {mixed} AS z FROM {f'j{k - 1}' if k else 'px'})")
        mixed = f"(xor(z, z // {1 << shift}{u}) * {times}{u}) % {m}"
    ctes.append(f"j2 AS (SELECT y, x, {mixed} AS z FROM j1)")
    half = max(1, min(W, H) // 8)
    inside = f"abs(x - {W // 2}) <= {half} AND abs(y - {H // 2}) <= {half}"
    jitter = f"CAST(xor(z, z // {1 << 31}{u}) // {1 << 40}{u} AS DOUBLE) / {1 << 24}"
    lap = lambda c: f"({_near(c, torus=True)} - 4 * {c})"
    made = "u * v * v"
    return f"""WITH RECURSIVE {EV}, px AS (SELECT CAST(i // {W} AS INT) AS y, CAST(i % {W} AS INT) AS x FROM range({W * H}) t(i)), {', '.join(ctes)},
gs AS (SELECT 0 AS n, y, x, CASE WHEN {inside} THEN 0.5::DOUBLE ELSE 1 END AS u, CASE WHEN {inside} THEN 0.25::DOUBLE + 0.04::DOUBLE * {jitter} ELSE 0 END AS v FROM j2
UNION ALL SELECT n + 1, y, x, u + ({du!r}::DOUBLE * {lap('u')} + {feed!r}::DOUBLE * (1 - u) - {made}), v + ({dv!r}::DOUBLE * {lap('v')} - {feed + kill!r}::DOUBLE * v + {made}) FROM gs WHERE n < {steps} WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y))
SELECT rid, y, x, round(CAST(CAST(u AS FLOAT) AS DOUBLE), 4) + 0.0 AS c0, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) + 0.0 AS c1 FROM gs, (SELECT DISTINCT rid FROM ev) WHERE n = {steps}"""


_WINDOWS = "WINDOW wx AS (PARTITION BY rid, y ORDER BY x), wy AS (PARTITION BY rid, x ORDER BY y)"


def _sweeps_sql(strength: float, sweeps: int, together: int = 5) -> str:
    """Chessboard sweeps to the fixed point, some nested in each step of the recursion."""
    us, rs = [f"u{i}" for i in range(4)], [f"r{i}" for i in range(4)]
    keep = ", ".join(["rid", "y", "x", "free", *rs])
    start = ", ".join([f"{D(c)} AS u{i}" for i, c in enumerate(RGBA)] + [f"{_near(D(o))} - 4 * {D(o)} - {strength!r}::DOUBLE * {D(c)} AS r{i}" for i, (c, o) in enumerate(zip(RGBA, _OTHER, strict=True))])
    body = "pb"
    for k in range(2 * together):
        new = ", ".join(f"CASE WHEN free AND (x + y) % 2 = {k % 2} THEN {u} + {solvers.OMEGA!r}::DOUBLE * (({_near(u)} - {r}) / {4 + strength!r}::DOUBLE - {u}) ELSE {u} END AS {u}" for u, r in zip(us, rs, strict=True))
        body = f"(SELECT n, {keep}, {new} FROM {body}{f' WHERE n < {sweeps // together}' if not k else ''} {_WINDOWS})"
    out = ", ".join(f"round(CAST(CAST({u} AS FLOAT) AS DOUBLE), 3) + 0.0 AS c{i}" for i, u in enumerate(us))
    return f"""WITH RECURSIVE {EV}, pb AS (SELECT 0 AS n, rid, y, x, m > 0.5 AND x > 0 AND y > 0 AND x < {W - 1} AND y < {H - 1} AS free, {start} FROM ev {_WINDOWS}
UNION ALL SELECT n + 1, rid, y, x, free, {', '.join(us + rs)} FROM {body})
SELECT rid, y, x, {out} FROM pb WHERE n = {sweeps // together}"""


def _descent_sql(step: float, smooth: float, steps: int) -> str:
    slope = f"(2 * (u - t) - {2 * smooth!r}::DOUBLE * ({_near('u', edge=True)} - 4 * u))"
    return f"""WITH RECURSIVE {EV}, gd AS (SELECT 0 AS n, rid, y, x, m > 0.5 AS free, {D('c0')} AS u, {D('b0')} AS t FROM ev
UNION ALL SELECT n + 1, rid, y, x, free, CASE WHEN free THEN u - {step!r}::DOUBLE * {slope} ELSE u END, t FROM gd WHERE n < {steps} {_WINDOWS})
SELECT rid, y, x, round(CAST(CAST(u AS FLOAT) AS DOUBLE), 5) + 0.0 AS c0 FROM gd WHERE n = {steps}"""


query("field_reaction_diffusion", lambda s: solvers.reaction_diffusion(s.gray, seed=3).select(*KEYS, *rounded(["c0", "c1"], 4)), _grey_scott_sql(1000, 3))
# Solved beyond the default tolerance, so that the fixed points agree to the digits shown.
query("repair_poisson_blend", lambda s: solvers.poisson_blend(s.other, s.rgba, s.mask, tolerance=1e-12).select(*KEYS, *rounded(["c0", "c1", "c2", "c3"], 3)), _sweeps_sql(0.0, 300))
query("repair_screened_poisson", lambda s: solvers.screened_poisson(s.other, s.rgba, s.mask, 0.5, tolerance=1e-12).select(*KEYS, *rounded(["c0", "c1", "c2", "c3"], 3)), _sweeps_sql(0.5, 300))
query("optimize_local_smooth", lambda s: solvers.optimize_local(s.gray, s.field, s.mask, smooth_weight=0.1, step=0.2, tolerance=0.0).select(*KEYS, *rounded(["c0"])), _descent_sql(0.2, 0.1, 120))
query("optimize_local", lambda s: solvers.optimize_local(s.gray, s.field, s.mask, step=0.2, max_iterations=5, tolerance=0.0).select(*KEYS, *rounded(["c0"], 4)),
      pixels(f"CASE WHEN m > 0.5 THEN {D('b0')} + ({D('c0')} - {D('b0')}) * pow({1 - 2 * 0.2!r}::DOUBLE, 5) ELSE c0 END", digits=4))

_CLAMP = lambda v, n: f"least(greatest({v}, 0), {n - 1})"
_P9 = [(j, i) for j in (-1, 0, 1) for i in (-1, 0, 1)]
_COST = " + ".join(f"(t.b{k} - s.a{k}) * (t.b{k} - s.a{k})" for k in range(9))


def _patch_sql(pairs: str) -> str:
    """``best``: each pixel's least patch among the pairs of one raster; a patch is 18 columns."""
    cells = ", ".join(f"max(CASE WHEN i = {i} AND j = {j} THEN p.{c} END)::DOUBLE AS {n}{k}" for k, (j, i) in enumerate(_P9) for c, n in (("c0", "a"), ("b0", "b")))
    return f"""patch AS MATERIALIZED (SELECT e.rid, e.y, e.x, any_value(e.m) AS m, {cells} FROM ev e, range(-1, 2) u(i), range(-1, 2) v(j), ev p WHERE p.rid = e.rid AND p.x = {_CLAMP('e.x + i', W)} AND p.y = {_CLAMP('e.y + j', H)} GROUP BY ALL),
best AS MATERIALIZED (SELECT rid, y, x, min({{'cost': cost, 'y': sy, 'x': sx}}) AS b FROM (SELECT t.rid, t.y, t.x, s.y AS sy, s.x AS sx, {_COST} AS cost FROM patch t JOIN patch s ON t.rid = s.rid {pairs}) GROUP BY rid, y, x)"""


_FIELD = lambda s: solvers.patch_field(s.gray, s.field, 1).select(*KEYS, "src_x", "src_y", *rounded(["cost"]))
_FIELD_SQL = f"WITH {EV}, {_patch_sql('')} SELECT rid, y, x, b.x AS src_x, b.y AS src_y, round(b.cost, 5) + 0.0 AS cost FROM best"
_FILL = "SELECT t.rid, t.y, t.x, round(CAST(CASE WHEN t.m > 0.5 THEN s.c0 ELSE t.b0 END AS DOUBLE), 5) + 0.0 AS c0 FROM ev t LEFT JOIN best ON best.rid = t.rid AND best.y = t.y AND best.x = t.x LEFT JOIN ev s ON s.rid = t.rid AND s.y = coalesce(best.b.y, t.y) AND s.x = coalesce(best.b.x, t.x)"
query("repair_patch_field", _FIELD, _FIELD_SQL)
query("repair_patch_field_whole", _FIELD, _FIELD_SQL)
query("repair_patch_synthesize", lambda s: show(solvers.patch_synthesize(s.gray, s.field, solvers.patch_field(s.gray, s.field, 1), s.mask)), f"WITH {EV}, {_patch_sql('')} {_FILL}")


def _synth_whole(s: Scene) -> DataFrame:
    """The hole is kept out of its own anchors."""
    field = solvers.patch_field(s.gray, s.field, 1, target_mask=s.mask, source_mask=masks.invert(s.mask))
    return show(solvers.patch_synthesize(s.gray, s.field, field, s.mask))


query("repair_patch_synthesize_whole", _synth_whole, f"WITH {EV}, {_patch_sql('WHERE t.m > 0.5 AND CAST(1 AS FLOAT) - s.m > 0.5')} {_FILL}")

# Reports
_LONG = f"{EV}, lg AS (" + " UNION ALL ".join(f"SELECT rid, y, x, {i} AS ch, CAST({c} AS DOUBLE) AS v, m FROM ev" for i, c in enumerate(RGBA)) + ")"
query("image_inspect", lambda s: reports.inspect(s.rgba).select("rid", "ch", *rounded(["v_min", "v_max", "v_sum", "v_sum_sq"]), "n_finite", "n_nonfinite"),
      f"WITH {_LONG} SELECT rid, ch, round(min(v), 5) + 0.0 AS v_min, round(max(v), 5) + 0.0 AS v_max, round(sum(v), 5) + 0.0 AS v_sum, round(sum(v * v), 5) + 0.0 AS v_sum_sq, count(*) AS n_finite, CAST(0 AS BIGINT) AS n_nonfinite FROM lg GROUP BY rid, ch")
query("image_content_hash", lambda s: reports.content_hash(s.rgba))
query("mask_bounds", lambda s: reports.bounds(s.mask).select("rid", "x0", "y0", "x1", "y1", "n", *rounded(["v_max", "mean", "rms"])),
      f"WITH {EV} SELECT rid, min(x) FILTER (m > 0) AS x0, min(y) FILTER (m > 0) AS y0, CAST(max(x) FILTER (m > 0) + 1 AS INT) AS x1, CAST(max(y) FILTER (m > 0) + 1 AS INT) AS y1, count(*) FILTER (m > 0) AS n, round(max(m)::DOUBLE, 5) + 0.0 AS v_max, round(avg(m::DOUBLE), 5) + 0.0 AS mean, round(sqrt(avg(m::DOUBLE * m)), 5) + 0.0 AS rms FROM ev GROUP BY rid")
_STAT = "n, round(v_min, 5) + 0.0 AS v_min, round(v_max, 5) + 0.0 AS v_max, round(v_sum, 5) + 0.0 AS v_sum, round(v_sum / n, 5) + 0.0 AS mean, round(greatest(0, sq / n - (v_sum / n) * (v_sum / n)), 5) + 0.0 AS variance"
query("analyze_statistics", lambda s: reports.statistics(s.rgba, s.mask).select("rid", "ch", "n", *rounded(["v_min", "v_max", "v_sum", "mean", "variance"])),
      f"WITH {_LONG}, g AS (SELECT rid, ch, count(*) AS n, min(v) AS v_min, max(v) AS v_max, sum(v) AS v_sum, sum(v * v) AS sq FROM lg WHERE m > 0 GROUP BY rid, ch) SELECT rid, ch, {_STAT} FROM g")
_BIN = f"CAST(CASE WHEN v < 0.1 THEN -1 WHEN v > 0.9 THEN 16 ELSE least(floor((v - 0.1::DOUBLE) / {(0.9 - 0.1) / 16!r}::DOUBLE), 15) END AS INT)"
query("analyze_histogram", lambda s: reports.histogram(s.rgba, 16, 0.1, 0.9),
      f"WITH {_LONG}, bins AS (SELECT rid, ch, CAST(b AS INT) AS bin FROM (SELECT DISTINCT rid, ch FROM lg), range(-1, 18) t(b)), counts AS (SELECT rid, ch, {_BIN} AS bin, count(*) AS n FROM lg GROUP BY ALL) SELECT rid, ch, bin, coalesce(n, 0) AS n FROM bins LEFT JOIN counts USING (rid, ch, bin)")
_DIFF = "dd AS (SELECT *, " + ", ".join(f"CAST(abs(CAST({o} AS DOUBLE) - {c}) AS FLOAT) AS d{i}" for i, (c, o) in enumerate(zip(RGBA, _OTHER, strict=True))) + " FROM ev), dm AS (SELECT *, CAST(greatest(d0, d1, d2, d3) AS DOUBLE) AS d FROM dd)"
_BOX = lambda on: f"count(*) FILTER ({on}) AS n, min(x) FILTER ({on}) AS x0, min(y) FILTER ({on}) AS y0, CAST(max(x) FILTER ({on}) + 1 AS INT) AS x1, CAST(max(y) FILTER ({on}) + 1 AS INT) AS y1"
query("analyze_diff", lambda s: reports.diff(s.rgba, s.other, threshold=0.6)[1].select("rid", *rounded(["v_max", "mean", "rms"]), "n", "x0", "y0", "x1", "y1"),
      f"WITH {EV}, {_DIFF} SELECT rid, round(max(d), 5) + 0.0 AS v_max, round(sum(d0::DOUBLE + d1 + d2 + d3) / (4 * count(*)), 5) + 0.0 AS mean, round(sqrt(sum(d0::DOUBLE * d0 + d1::DOUBLE * d1 + d2::DOUBLE * d2 + d3::DOUBLE * d3) / (4 * count(*))), 5) + 0.0 AS rms, {_BOX('d > 0.6')} FROM dm GROUP BY rid")
query("analyze_diff_field", lambda s: show(reports.diff(s.rgba, s.other)[0]), pixels("d0", "d1", "d2", "d3", source="dm", ctes=f"{EV}, {_DIFF}"))
query("analyze_changed_bounds", lambda s: reports.changed_bounds(reports.diff(s.rgba, s.other)[0], 0.9), f"WITH {EV}, {_DIFF} SELECT rid, {_BOX('d > 0.9')} FROM dm GROUP BY rid")
_ENERGY = " UNION ALL ".join(f"SELECT rid, {i} AS level, sum(CAST(c0 AS DOUBLE) * c0) AS energy, count(*) AS n FROM {t} GROUP BY rid" for i, t in enumerate(("d0", "d1", "l2")))
_MASKED = lambda on, column="c0": _LAP.replace("l0 AS (SELECT rid, y, x, c0 FROM ev)", f"l0 AS (SELECT rid, y, x, CASE WHEN {on} THEN {column} ELSE CAST(0 AS FLOAT) END AS c0 FROM ev)")
query("analyze_frequency_energy", lambda s: reports.frequency_energy(s.gray, 3, s.mask).select("rid", "level", *rounded(["energy"], 3), "n"), f"WITH {EV}, {_MASKED('m > 0')}, en AS ({_ENERGY}) SELECT rid, level, round(energy, 3) + 0.0 AS energy, n FROM en")

# Assertions


def _verdict_sql(excess: str, bad: str, source: str, ctes: str) -> str:
    order = f"{excess} DESC, y, x"
    return f"WITH {ctes} SELECT rid, count(*) FILTER ({bad}) = 0 AS passed, count(*) FILTER ({bad}) AS n, coalesce(round(first({excess} ORDER BY {order}) FILTER ({bad}), 5), -1) + 0.0 AS excess, coalesce(first(y ORDER BY {order}) FILTER ({bad}), -1) AS y, coalesce(first(x ORDER BY {order}) FILTER ({bad}), -1) AS x FROM {source} GROUP BY rid"


def _verdict(rows: DataFrame) -> DataFrame:
    """-1 stands where nothing is wrong."""
    return rows.fillna(-1).select("rid", "passed", "n", *rounded(["excess"]), "y", "x")




def _holed(s: Scene) -> Raster:
    """The image with not-a-number at one place of every second raster and an infinite column in every third."""
    first, second, third, alpha = s.rgba.channels
    every, some = (F.col("rid") % 2 == 0) & (F.col("x") == 7) & (F.col("y") == 3), (F.col("rid") % 3 == 0) & (F.col("x") == 60)
    return s.rgba.but(F.when(every, float("nan")).otherwise(first), F.when(some, float("-inf")).otherwise(second), third, alpha)


query("assert_finite", lambda s: _verdict(reports.assert_finite(_holed(s))), _verdict_sql("e", "e > 0", "ex", f"{EV}, ex AS (SELECT *, CASE WHEN rid % 2 = 0 AND x = 7 AND y = 3 OR rid % 3 = 0 AND x = 60 THEN 'inf'::DOUBLE ELSE 0 END AS e FROM ev)"))
_EXC = "greatest(" + ", ".join(f"0.05::DOUBLE - {c}, {c} - 0.95::DOUBLE" for c in (D(c) for c in RGBA)) + ", 0)"
query("assert_range", lambda s: _verdict(reports.assert_range(s.rgba, 0.05, 0.95)), _verdict_sql("e", "e > 0", "ex", f"{EV}, ex AS (SELECT *, {_EXC} AS e FROM ev)"))
query("assert_range_locations", lambda s: reports.locations(reports.assert_range(s.rgba, 0.05, 0.95)),
      f"WITH {EV}, ex AS (SELECT *, {_EXC} AS e FROM ev) SELECT rid, y, x FROM ex WHERE e > 0 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY y, x) <= {reports.LOCATIONS}")
_ALPHA = "greatest(" + ", ".join(f"abs({D(c)}) - {D('c3')}" for c in RGBA[:3]) + f", -{D('c3')}, {D('c3')} - 1, 0)"
query("assert_alpha_valid", lambda s: _verdict(reports.assert_alpha_valid(Raster(s.rgba.frame, s.rgba.channels, W, H, alpha="premultiplied", has_alpha=True))), _verdict_sql("e", "e > 0", "ex", f"{EV}, ex AS (SELECT *, {_ALPHA} AS e FROM ev)"))
query("assert_changed_bounds", lambda s: _verdict(reports.assert_changed_bounds(s.rgba, s.other, (0, 0, 90, 9), 0.5)), _verdict_sql("d", "d > 0.5 AND NOT (x < 90 AND y < 9)", "dm", f"{EV}, {_DIFF}"))
query("assert_no_change_outside_mask", lambda s: _verdict(reports.assert_no_change_outside_mask(s.rgba, s.other, s.mask, outside_threshold=0.25, coverage_epsilon=0.1)), _verdict_sql("d", "m <= CAST(0.1 AS FLOAT) AND d > 0.25", "dm", f"{EV}, {_DIFF}"))


def _leak_free(s: Scene) -> DataFrame:
    box = masks.rect(s.rgba, 10.25, 1.5, 70.75, 8.125)
    edited = paint.fill(s.rgba, s.mask, [0.2, 0.4, 0.6, 1.0])
    return _verdict(reports.assert_no_change_outside_mask(s.rgba, paint.masked_replace(edited, s.rgba, box), box))


query("masked_edit_flow", _leak_free, f"WITH {EV} SELECT rid, true AS passed, CAST(0 AS BIGINT) AS n, -1.0::DOUBLE AS excess, CAST(-1 AS INT) AS y, CAST(-1 AS INT) AS x FROM ev GROUP BY rid")


def _preserved(s: Scene) -> DataFrame:
    rows = reports.assert_frequency_preserved(s.gray, s.field, 3, 0.05, s.mask)
    return rows.select("rid", "passed", "n", *rounded(["worst"], 3), "level")


def _preserved_sql() -> str:
    parts = []
    for name, column in (("bef", "c0"), ("aft", "b0")):
        body = _MASKED("NOT (m > 0)", column)
        for table in ("l0", "l1", "l2", "b0_", "b1_", "d0", "d1"):
            body = body.replace(f"{table}_x ", f"{name}{table}_x ").replace(f"{table} ", f"{name}{table} ")
        body = body.replace("THEN befb0 ", "THEN b0 ").replace("THEN aftb0 ", "THEN b0 ")
        energy = " UNION ALL ".join(f"SELECT rid, {i} AS level, sum(CAST(c0 AS DOUBLE) * c0) AS energy FROM {name}{t} GROUP BY rid" for i, t in enumerate(("d0", "d1", "l2")))
        parts.append(f"{body}, {name} AS ({energy})")
    return f"WITH {EV}, {parts[0]}, {parts[1]}, ch AS (SELECT bef.rid, bef.level, abs(aft.energy - bef.energy) / (bef.energy + 1e-9::DOUBLE) AS c FROM bef JOIN aft USING (rid, level)) SELECT rid, count(*) FILTER (c > 0.05) = 0 AS passed, count(*) FILTER (c > 0.05) AS n, round(max(c), 3) + 0.0 AS worst, CAST(first(level ORDER BY c DESC, level) AS INT) AS level FROM ch GROUP BY rid"


query("assert_frequency_preserved", _preserved, _preserved_sql())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked edit and its proof that nothing changed outside the mask."""
    return QUERIES["masked_edit_flow"](spark, sf_dir)
