"""Raster operators: every twin query, and laws and closed forms that need no oracle."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquarry import queries
from pixelquarry.operators import filters, frequency, geometry, masks, paint, pointwise, reports, solvers, topology
from pixelquarry.plans.raster import Raster, RasterError
from pixelquarry.sources import generate, png

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return float(value) if isinstance(value, float | np.floating) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    rows = [tuple(plain(v) for v in r) for r in got.select(columns).collect()]
    assert sorted(rows, key=str) == sorted([tuple(plain(v) for v in r) for r in want], key=str)


def raster(spark, grid, **more):
    grid = np.asarray(grid, dtype=float)
    h, w = grid.shape[:2]
    flat = grid.reshape(h, w, -1)
    n = flat.shape[2]
    rows = [(0, y, x, *map(float, flat[y, x])) for y in range(h) for x in range(w)]
    frame = spark.createDataFrame(rows, "rid long, y int, x int, " + ", ".join(f"c{i} float" for i in range(n)))
    return Raster(frame, tuple(F.col(f"c{i}") for i in range(n)), w, h, **more)


def values(r):
    out = np.zeros((r.height, r.width, len(r.channels)))
    for row in r.table().collect():
        out[row["y"], row["x"]] = [row[f"c{i}"] for i in range(len(r.channels))]
    return out[..., 0] if out.shape[2] == 1 else out


def test_flips_and_turns_undo_each_other(spark):
    grid = np.random.default_rng(0).random((3, 5))
    r = raster(spark, grid)
    assert np.allclose(values(geometry.flip(geometry.flip(r, "both"), "both")), grid, atol=1e-6)
    turned = r
    for _ in range(4):
        turned = geometry.rotate90(turned, 1)
    assert np.allclose(values(turned), grid, atol=1e-6)
    assert np.allclose(values(geometry.rotate90(r, 1)), np.rot90(grid, -1), atol=1e-6)


def test_mirror_padding_does_not_repeat_the_edge(spark):
    grid = np.arange(12.0).reshape(3, 4)
    assert np.array_equal(values(geometry.pad(raster(spark, grid), 2, 1, 1, 2, "mirror")), np.pad(grid, ((1, 2), (2, 1)), mode="reflect"))


def test_distance_is_exact(spark):
    on = np.zeros((6, 7))
    on[1:3, 2:5] = 1
    got = values(masks.mask_to_sdf(raster(spark, on)))
    for y in range(6):
        for x in range(7):
            to = lambda v: min(math.dist((y, x), p) for p in np.argwhere(on == v))  # noqa: B023, E731
            assert got[y, x] == pytest.approx(to(1) - to(0), abs=1e-6)
    assert np.all(values(masks.mask_to_sdf(raster(spark, np.zeros((2, 2))))) == np.inf)


def test_components_are_numbered_by_their_first_pixel(spark):
    on = np.array([[0, 1, 0, 1], [0, 1, 0, 0], [1, 0, 0, 1]])
    labels, areas = topology.connected_components(raster(spark, on), 4)
    got = {(r["y"], r["x"]): r["label"] for r in labels.collect()}
    assert [got[p] for p in [(0, 1), (1, 1), (0, 3), (2, 0), (2, 3), (0, 0)]] == [1, 1, 2, 3, 4, 0]
    assert {r["label"]: r["area"] for r in areas.collect()} == {1: 2, 2: 1, 3: 1, 4: 1}


def test_nan_and_infinity_are_guarded(spark):
    r = raster(spark, [[math.nan, math.inf], [-math.inf, 0.5]])
    row = reports.inspect(r).collect()[0]
    assert (row["v_min"], row["v_max"], row["n_finite"], row["n_nonfinite"]) == (0.5, 0.5, 1, 3)
    assert reports.assert_range(r, 0.0, 1.0).collect()[0]["n"] == 3
    assert reports.assert_finite(r).collect()[0]["passed"] is False
    assert {b["bin"]: b["n"] for b in reports.histogram(r, 2, 0.0, 1.0).collect()} == {-1: 0, 0: 0, 1: 1, 2: 0, 3: 3}
    assert reports.bounds(r).collect()[0]["n"] == 1
    assert r.frame.select(png.quantized(F.col("c0"))).collect()[0][0] == 0


def test_png_round_trip_and_filters():
    image = np.random.default_rng(1).integers(0, 256, (5, 4, 3)).astype(np.uint8)
    assert np.array_equal(png.decode(png.encode(image)), image)
    row, above = np.array([3, 250, 9, 7], np.uint8), np.array([1, 2, 3, 4], np.uint8)
    assert list(png._unfilter(1, row, above, 1)) == [3, 253, 6, 13]
    assert list(png._unfilter(2, row, above, 1)) == [4, 252, 12, 11]
    with pytest.raises(RasterError):
        png.decode(b"nothing")


def test_noise_is_bounded_and_seeded(spark):
    a, b = (values(generate.noise(spark, 40, 20, 8.0, seed)) for seed in (1, 2))
    assert np.abs(a).max() <= 1 and not np.allclose(a, b)
    assert np.array_equal(a, values(generate.noise(spark, 40, 20, 8.0, 1)))


def test_reaction_diffusion_stays_uniform_without_feed_of_v(spark):
    rows = solvers.reaction_diffusion(raster(spark, np.zeros((16, 16))), steps=0).toPandas()
    square = rows[(abs(rows.x - 8) <= 2) & (abs(rows.y - 8) <= 2)]
    assert (square.c0 == 0.5).all() and square.c1.between(0.25, 0.29).all()
    assert (rows.drop(square.index).c1 == 0).all()
    with pytest.raises(RasterError):
        solvers.reaction_diffusion(raster(spark, np.zeros((4, 4))), diffusion_u=1.0)


def test_poisson_keeps_a_target_whose_gradients_it_gets(spark):
    grid = np.random.default_rng(2).random((8, 9))
    mask = np.ones((8, 9))
    got = solvers.poisson_blend(raster(spark, grid + 0.2), raster(spark, grid), raster(spark, mask)).toPandas()
    assert np.allclose(got.sort_values(["y", "x"]).c0.to_numpy().reshape(8, 9), grid, atol=1e-3)


def test_patches_are_matched_over_whole_rasters_and_within_masks(spark):
    rng = np.random.default_rng(5)
    source, target, hole = rng.random((4, 20)), rng.random((4, 20)), rng.random((4, 20)) > 0.6
    around = lambda g, y, x: np.pad(g.astype(np.float32).astype(float), 1, mode="edge")[y : y + 3, x : x + 3]
    r = [raster(spark, g) for g in (source, target, hole, ~hole, 0 * source)]
    places = [(y, x) for y in range(4) for x in range(20)]
    for more, wanted, anchors in (({}, places, places), ({"target_mask": r[2], "source_mask": r[3]}, [p for p in places if hole[p]], [p for p in places if not hole[p]]), ({"source_mask": r[3]}, places, [p for p in places if not hole[p]]), ({"target_mask": r[2], "source_mask": r[4]}, [p for p in places if hole[p]], [])):
        got = {(g["y"], g["x"]): g for g in solvers.patch_field(r[0], r[1], 1, **more).collect()}
        assert sorted(got) == places
        for p in places:
            cost, at = (min((((around(target, *p) - around(source, *q)) ** 2).sum(), q) for q in anchors) if anchors else (np.inf, p)) if p in wanted else (0.0, p)
            assert (got[p]["src_y"], got[p]["src_x"]) == at and got[p]["cost"] == pytest.approx(cost)


def test_the_whole_patch_queries_keep_every_pixel(spark):
    n = queries.Scene(spark, SF).gray.table().count()
    rows = queries.QUERIES["repair_patch_field_whole"](spark, SF).toPandas()
    assert len(rows) == n and rows.src_x.max() >= 12
    assert queries.QUERIES["repair_patch_synthesize_whole"](spark, SF).count() == n


def test_bandpass_of_everything_is_the_image(spark):
    grid = np.random.default_rng(3).random((6, 8))
    assert np.allclose(values(frequency.bandpass(raster(spark, grid), 0.0, 1.0)), grid, atol=1e-5)


def test_bad_parameters_are_refused(spark):
    r = raster(spark, np.zeros((3, 3)))
    for call in (lambda: geometry.crop(r, 0, 0, 9, 1), lambda: geometry.flip(r, "none"), lambda: pointwise.extract_channel(r, 1), lambda: pointwise.premultiply(r), lambda: paint.fill(r, r, [0.1, 0.2]), lambda: generate.create(spark, 2, 2, "gray", [2.0]), lambda: filters.gaussian_blur(r, -1.0)):
        with pytest.raises(RasterError):
            call()


def test_same_frame_needs_no_shuffle(spark):
    s = queries.Scene(spark, SF)
    edited = paint.fill(s.rgba, s.mask, [0.2, 0.4, 0.6, 1.0])
    plan = paint.masked_replace(edited, s.rgba, masks.rect(s.rgba, 1, 1, 5, 5)).table()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_distance_over_long_lines(spark):
    rng = np.random.default_rng(7)
    for n, share in ((1, 0.5), (2, 0.5), (77, 0.02), (130, 0.9)):
        gap = np.where(rng.random((5, n)) < share, rng.integers(0, 40, (5, n)).astype(float), np.inf)
        places = np.arange(n)
        wanted = ((places[:, None] - places[None, :]) ** 2 + (gap * gap)[:, None, :]).min(axis=2)
        assert np.array_equal(masks._least_squares_along(gap), wanted)
    on = rng.random((70, 90)) < 0.01
    got, seeds, others = values(masks.mask_to_sdf(raster(spark, on.astype(float)))), np.argwhere(on), np.argwhere(~on)
    to = lambda places, p: np.sqrt(((places - np.array(p)) ** 2).sum(axis=1).min())
    assert all(got[p] == pytest.approx(to(seeds, p) - to(others, p), abs=1e-5) for p in np.ndindex(on.shape))


def test_filters_agree_across_tiles_and_batches(spark):
    grid = np.random.default_rng(8).random((70, 150))
    r = raster(spark, grid)
    kernel = np.random.default_rng(9).random((5, 3))
    for mode, pad, more in (("mirror", "reflect", {}), ("wrap", "wrap", {}), ("clamp", "edge", {}), ("constant", "constant", {"constant_values": 0.3})):
        p = np.pad(grid, ((2, 2), (1, 1)), pad, **more)
        wanted = sum(kernel[j, i] * p[j : j + 70, i : i + 150] for j in range(5) for i in range(3))
        assert np.allclose(values(filters.convolve(r, 3, 5, kernel.ravel().tolist(), mode=mode, value=0.3)), wanted, atol=1e-5)
    far = values(filters.convolve(r, 1, 1, [1.0], origin=(140, 0), mode="constant", value=0.5))  # whole tiles see nothing but the constant
    assert np.allclose(far[:, 140:], grid[:, :10], atol=1e-6) and np.all(far[:, :140] == 0.5)
    p = np.pad(grid, 3, "edge")
    near = np.stack([p[j : j + 70, i : i + 150] for j in range(7) for i in range(7)])
    w = np.exp(-np.array([(j - 3) ** 2 + (i - 3) ** 2 for j in range(7) for i in range(7)]) / 2)[:, None, None] * np.exp(-((near - grid) ** 2) / (2 * 0.2**2))
    assert np.allclose(values(filters.bilateral(r, 1.0, 0.2)), (w * near).sum(0) / w.sum(0), atol=1e-5)
    w = np.exp(-(np.arange(-12, 13.0) ** 2) / 32)
    along = lambda g, axis: np.apply_along_axis(lambda v: np.convolve(np.pad(v, 12, "edge"), w / w.sum(), "valid"), axis, g)
    assert np.allclose(values(filters.gaussian_blur(r, 4.0)), along(along(grid, 1), 0), atol=1e-5)


def test_reports_list_the_first_violations(spark):
    grid = np.zeros((20, 30))
    grid[5:] = 2.0
    report = reports.assert_range(raster(spark, grid), 0.0, 1.0)
    row = report.collect()[0]
    assert row["n"] == 450 and [(p["y"], p["x"]) for p in row["places"]] == [(5 + i // 30, i % 30) for i in range(reports.LOCATIONS)]
    assert reports.locations(report).count() == reports.LOCATIONS
    assert reports.assert_range(raster(spark, grid), 0.0, 3.0).collect()[0]["places"] == []


def test_a_mask_sample_stored_as_epsilon_is_outside(spark):
    """0.1 in single precision is above 0.1 in double precision."""
    before, after, allowed = raster(spark, [[0, 0, 0]]), raster(spark, [[1, 1, 1]]), raster(spark, [[0.05, 0.1, 0.2]])
    report = reports.assert_no_change_outside_mask(before, after, allowed, coverage_epsilon=0.1)
    assert [tuple(r) for r in reports.locations(report).collect()] == [(0, 0, 0), (0, 0, 1)]


def test_png_files_are_written_whole(spark, tmp_path):
    grid = np.random.default_rng(4).integers(0, 256, (6, 5)) / 255
    r = raster(spark, grid)
    for _ in range(2):  # again over the same files
        assert png.write_images(r, str(tmp_path)) == 1
        assert [p.name for p in tmp_path.iterdir()] == ["0.png"]
    rows = png.decode_images(spark, str(tmp_path)).toPandas().sort_values(["y", "x"])
    assert np.allclose(rows.v.to_numpy().reshape(6, 5), grid, atol=1e-6)
    with pytest.raises(RasterError):
        png.write_images(r, str(tmp_path / "none"))


def test_many_splats_equal_few_at_a_time(spark):
    rng = np.random.default_rng(6)
    s = queries.Scene(spark, SF)
    blends = ["normal", "multiply", "add", "screen", "lighten"]
    splats = [
        {"center_px": rng.uniform((-5, -5), (105, 15)).tolist(), "sigma_px": rng.uniform(0.2, 3, 2).tolist(), "angle_rad": float(rng.uniform(0, 3)), "color": rng.uniform(0, 1, 4).tolist(), "opacity": 0.7, "blend": blends[k % 5], "hardness": 0.1 * (k % 3)}
        for k in range(40)
    ]
    some = s.rgba
    for k in range(0, 40, 10):
        some = paint.gaussian_splats(some, splats[k : k + 10])
    wanted = some.table().toPandas().sort_values(["rid", "y", "x"])
    got = paint.gaussian_splats(s.rgba, splats).table().toPandas().sort_values(["rid", "y", "x"])
    assert len(got) == len(wanted) and np.allclose(got.to_numpy(), wanted.to_numpy(), atol=1e-5)
    assert paint.gaussian_splats(s.rgba, [{**splats[0], "center_px": [10.0 * (k % 10), k % 7]} for k in range(2000)]).table().count() == len(got)
    with pytest.raises(RasterError):
        paint.gaussian_splats(s.rgba, [{**splats[0], "sigma_px": [0.0, 1.0]}] * 20)


def test_components_agree_across_tiles(spark):
    rng = np.random.default_rng(11)
    on = rng.random((23, 31)) < 0.55
    for connectivity in (4, 8):
        for tile in (4, 7, 64):
            pixels, groups = topology.components(raster(spark, on.astype(float)), connectivity, tile)
            first = {r["root"]: r["first"] for r in groups.collect()}
            wanted = topology.first_places(on, connectivity)
            rows = pixels.collect()
            assert len(rows) == on.size
            assert all((first[r["root"]] if r["root"] is not None else on.size) == wanted[r["y"], r["x"]] for r in rows)
    ring = np.zeros((300, 280))
    ring[10:290, 12] = ring[10:290, 270] = ring[10, 12:271] = ring[289, 12:271] = 1
    assert values(topology.fill_holes(raster(spark, ring), 4)).sum() == 280 * 259
    assert values(topology.remove_components(raster(spark, ring), int(ring.sum()) + 1)).sum() == 0
    assert np.array_equal(values(topology.remove_components(raster(spark, ring), int(ring.sum()))), ring)


def test_content_hash_is_of_the_samples_in_order(spark):
    grid = np.array([[0.5, -0.0, np.nan], [np.inf, 1e-40, 2.0]])
    bits = grid.astype("<f4").view("<u4")
    bits[0, 2] = 0x7FC00000
    wanted = hashlib.sha256(np.array([3, 2, 1], "<u4").tobytes() + bits.tobytes()).hexdigest()
    assert reports.content_hash(raster(spark, grid)).collect()[0]["content_hash"] == f"sha256:{wanted}"
