"""Flats, polygons on grids, projections, mosaics, listings and stored windows against direct computation."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import features, flats, raster, spatial, zonal
from gaugeline.operators.raster import STEPS
from gaugeline.sources import inventory, windows

INF = float("inf")


def grid_frame(spark, z, basin="A"):
    rows = [(basin, r, c, None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "basin string, row int, col int, z double").repartition(3)


def brute_distances(z, seeds, passable):
    dist = {p: 0 for p in seeds}
    front = list(seeds)
    while front:
        nxt = []
        for r, c in front:
            for dr, dc in STEPS:
                q = (r + dr, c + dc)
                if q in passable and q not in dist and z[q] == z[r, c]:
                    dist[q] = dist[r, c] + 1
                    nxt.append(q)
        front = nxt
    return dist


def brute_flats(z):
    """Pointers of every cell by definition."""
    cells = {p for p, v in np.ndenumerate(z) if not math.isnan(v)}

    def near(p):
        return [(p[0] + dr, p[1] + dc) for dr, dc in STEPS if (p[0] + dr, p[1] + dc) in cells]

    to = {}
    for p in cells:
        falls = [((z[p] - z[q]) / (math.sqrt(2) if p[0] != q[0] and p[1] != q[1] else 1.0), -i, q) for i, q in enumerate(near(p)) if z[q] < z[p]]
        to[p] = max(falls)[2] if falls else None
    still = {p for p in cells if to[p] is None and any(z[q] == z[p] for q in near(p))}
    outlets = {p for p in cells if to[p] and any(z[q] == z[p] for q in near(p))}
    low = brute_distances(z, outlets, still | outlets)
    high = brute_distances(z, {p for p in still if any(z[q] > z[p] for q in near(p))}, still)
    value = {p: -INF if low[p] == 0 else 2 * low[p] - (high[p] + 1 if p in high else 0) for p in low}
    for p in still & set(low):
        to[p] = min((q for q in near(p) if z[q] == z[p] and q in value), key=lambda q: value[q])
    return to


@pytest.mark.parametrize("seed, tile", [(1, 256), (2, 4), (3, 5)])
def test_flats(spark, seed, tile):
    rng = np.random.default_rng(seed)
    z = np.round(np.add.outer(np.arange(22), np.arange(17)) / 9 + rng.random((22, 17)) * 1.2)
    z[3:9, 2:12] = 1                      # a wide floor, and a hollow without an outlet
    z[15:19, 5:11], z[16:18, 6:10] = 7, -2
    z[rng.random(z.shape) < 0.04] = np.nan
    got = {(r.row, r.col): None if r.to_row is None else (r.to_row, r.to_col) for r in flats.d8_flats(grid_frame(spark, z), tile).collect()}
    want = brute_flats(z)
    assert got == want
    plain = {(r.row, r.col) for r in raster.d8_pointer(grid_frame(spark, z)).where("to_row IS NOT NULL").collect()}
    assert plain < {p for p, q in got.items() if q}
    for p in got:                          # every path ends, below all of its cells or in a hollow
        seen = set()
        while got[p] and p not in seen:
            seen.add(p)
            p = got[p]
        assert p not in seen


def test_a_long_winding_flat(spark):
    """One channel of equal height that crosses tile borders many times, its outlet at one end."""
    z = np.full((12, 12), 9.0)
    for k, r in enumerate(range(0, 12, 4)):
        z[r, :] = 5
        z[r + 1:r + 4, 11 if k % 2 == 0 else 0] = 5
    z[11, 11] = 1
    got = {(r.row, r.col): (r.to_row, r.to_col) for r in flats.d8_flats(grid_frame(spark, z), 4).collect()}
    p, steps = (0, 0), 0
    while p != (11, 11):
        p, steps = got[p], steps + 1
    assert steps > 35
    acc = raster.flow_accumulation(flats.d8_flats(grid_frame(spark, z), 4), 4)
    assert acc.where("row = 11 AND col = 11").first().acc == 144
    assert flats.d8_flats(grid_frame(spark, z).limit(0)).count() == 0


# ---- polygons ---------------------------------------------------------------------------

RING = "array<struct<x: double, y: double>>"


def brute_inside(x, y, rings):
    crossings = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 <= y) != (y2 <= y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) <= x:
                crossings += 1
    return crossings % 2 == 1


def polygon_cases():
    rng = random.Random(4)

    def star(cx, cy, r, n):
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        return [(cx + r * rng.uniform(0.3, 1) * math.cos(a), cy + r * rng.uniform(0.3, 1) * math.sin(a)) for a in angles]

    cases = {f"star{k}": [star(rng.uniform(0, 30), rng.uniform(-25, 0), rng.uniform(1, 12), 9)] for k in range(8)}
    square = lambda a, b, w: [(a, b), (a, b - w), (a + w, b - w), (a + w, b)]
    cases["nested"] = [square(2.2, -1.3, 20), square(5.1, -4.2, 12), square(8.3, -8.1, 4)]
    cases["reversed"] = [square(2.2, -1.3, 20)[::-1], square(5.1, -4.2, 12)]
    cases["parts"] = [square(0.4, -0.2, 3), square(25.5, -18.5, 4.5)]
    cases["whole"] = [square(-5, 5, 60)]
    cases["outside"] = [square(500, 500, 3)]
    cases["sliver"] = [square(3.6, -3.6, 0.1)]
    return cases


def test_zonal_by_polygon(spark, monkeypatch):
    monkeypatch.setattr(zonal, "SPAN_COLS", 8)
    rng = np.random.default_rng(5)
    z = rng.random((24, 31)) * 100
    z[rng.random(z.shape) < 0.05] = np.nan
    cases = polygon_cases()
    shapes = spark.createDataFrame([(k, "A", [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in cases.items()],
                                   f"clave string, basin string, rings array<{RING}>")
    got = {r.clave: r for r in zonal.zonal_by_polygon(grid_frame(spark, z), shapes, zonal.Grid(0.0, 0.0, 1.0), geographic=False).collect()}
    assert got.keys() == cases.keys()
    for k, rings in cases.items():
        inside = {(r, c) for r, c in np.ndindex(*z.shape) if brute_inside(c + 0.5, -(r + 0.5), rings)}
        masked = np.full(z.shape, np.nan)
        for p in inside:
            masked[p] = z[p]
        xs, ys = [p[0] for ring in rings for p in ring], [p[1] for ring in rings for p in ring]
        r0, r1 = max(0, math.floor(-max(ys))), min(23, math.ceil(-min(ys)) - 1)
        c0, c1 = max(0, math.floor(min(xs))), min(30, math.ceil(max(xs)) - 1)
        window = masked[r0:r1 + 1, c0:c1 + 1]
        values = window[~np.isnan(window)] if window.size else np.array([])
        assert got[k].celdas == len(values), k
        if not len(values):
            assert got[k].elevacion_media is None and got[k].pendiente_media is None
            continue
        assert got[k].elevacion_media == pytest.approx(values.mean())
        if min(window.shape) > 1:
            gy, gx = np.gradient(window)
            slope = np.degrees(np.arctan(np.hypot(gx, gy)))
            if np.isnan(slope).all():
                assert got[k].pendiente_media is None
            else:
                assert got[k].pendiente_media == pytest.approx(np.nanmean(slope))
    for k, want in {"nested": 400 - 144 + 16, "reversed": 400 - 144, "parts": 9 + 20.25}.items():
        assert got[k].area_km2 == pytest.approx(want / 1e6)


def test_neighbouring_polygons_share_no_pixel(spark):
    """Boundaries through pixel centres: each centre belongs to one side."""
    z = np.ones((6, 6))
    square = lambda a, b: [[{"x": float(x), "y": float(y)} for x, y in ((a, b), (a + 3, b), (a + 3, b - 3), (a, b - 3))]]
    rows = [(f"{i}{j}", "A", square(-0.5 + 3 * i, 0.5 - 3 * j)) for i, j in itertools.product(range(3), range(3))]
    polygons = spark.createDataFrame(rows, f"clave string, basin string, rings array<{RING}>")
    found = zonal.pixels_in_polygons(grid_frame(spark, z), polygons, zonal.Grid(0.0, 0.0, 1.0)).collect()
    assert len(found) == 36 == len({(r.row, r.col) for r in found})


def test_basins_with_holes_and_parts(spark):
    rings = polygon_cases()["nested"]
    basins = spark.createDataFrame([("12", "n", [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings])],
                                   f"region_hidrologica string, cuenca string, rings array<{RING}>")
    rng = random.Random(6)
    points = [(f"p{k}", rng.uniform(-30, 3), rng.uniform(0, 30)) for k in range(300)] + [("edge", -4.2, 7.0), ("none", None, 3.0)]
    got = spatial.assign_basin(spark.createDataFrame(points, "clave string, latitud double, longitud double"), basins).collect()
    assert len(got) == len(points)
    assert {r.clave for r in got if r.cuenca} == {k for k, y, x in points if k[0] == "p" and brute_inside(x, y, rings)}


# ---- projection -------------------------------------------------------------------------

def test_inverse_projection(spark):
    rng = random.Random(7)
    points = [(k, rng.uniform(12, 34), rng.uniform(-120, -84)) for k in range(400)]
    back = spatial.to_geographic(spatial.reproject(spark.createDataFrame(points, "k int, lat0 double, lon0 double"), "lat0", "lon0")).collect()
    for r in back:
        assert abs(r.latitud - r.lat0) * 111_000 < 1e-3 and abs(r.longitud - r.lon0) * 111_000 < 1e-3


def test_bounds_follow_curved_edges(spark):
    """The northern edge of a wide box bends beyond its corners; bounds there and back hold the box."""
    box = spark.createDataFrame([("A", -112.0, 15.0, -92.0, 25.0)], "basin string, min_lon double, min_lat double, max_lon double, max_lat double")
    m = spatial.metric_bounds(box)
    r = m.first()
    corners = spatial.reproject(spark.createDataFrame([(a, b) for a in (15.0, 25.0) for b in (-112.0, -92.0)], "latitud double, longitud double")).collect()
    assert r.min_y < min(c.y_m for c in corners) - 1000
    assert r.max_x == pytest.approx(max(c.x_m for c in corners))
    back = spatial.geographic_bounds(m.select("basin", "min_x", "min_y", "max_x", "max_y")).first()
    assert back.min_lon <= -112 and back.max_lon >= -92 and back.min_lat <= 15 and back.max_lat >= 25


# ---- mosaic -----------------------------------------------------------------------------

def test_mosaic_of_shifted_and_coarser_tiles(spark):
    rng = np.random.default_rng(8)
    frames = {"a": (10.0, 50.0, 1.0), "b": (13.3, 48.7, 1.0), "c": (8.2, 51.1, 2.5), "d": (11.0, 49.0, 0.4)}
    tiles = {p: rng.random((9, 7)) for p in frames}
    tiles["a"][2:5, 3] = np.nan
    rows = [(p, "A", r, c, None if math.isnan(v) else float(v)) for p, t in tiles.items() for (r, c), v in np.ndenumerate(t)]
    got = raster.mosaic_aligned(spark.createDataFrame([*rows, ("lost", "A", 0, 0, 1.0)], "path string, basin string, row int, col int, z double"),
                                spark.createDataFrame([(p, "A", *f) for p, f in frames.items()], "path string, basin string, west double, north double, cell double"))
    west, north = min(f[0] for f in frames.values()), max(f[1] for f in frames.values())
    want = {}
    for r, c in itertools.product(range(-2, 40), range(-2, 40)):
        x, y = west + c + 0.5, north - r - 0.5
        for p, (w, n, cell) in frames.items():
            i, j = math.floor((n - y) / cell), math.floor((x - w) / cell)
            if 0 <= i < 9 and 0 <= j < 7 and not math.isnan(tiles[p][i, j]):
                want.setdefault((r, c), float(tiles[p][i, j]))
    assert {(r.row, r.col): r.z for r in got.collect()} == want


# ---- files ------------------------------------------------------------------------------

def test_all_files_are_listed(spark, tmp_path):
    names = ["a.csv", "_b.csv", ".c", "x/y/_z/d", "x/.e/f", "_g/h"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "empty/_none").mkdir(parents=True)
    got = {r.path: r.length for r in inventory.list_all_files(spark, str(tmp_path)).collect()}
    assert got == {f"file:{tmp_path}/{n}": len(n) for n in names}
    assert [r.length for r in inventory.list_all_files(spark, f"file:{tmp_path}/_g/h").collect()] == [4]
    assert inventory.list_all_files(spark, f"{tmp_path}/absent").count() == 0
    assert {r.path for r in inventory.list_files(spark, str(tmp_path)).collect()} == {f"file:{tmp_path}/a.csv"}
    assert inventory.manifest(inventory.list_all_files(spark, str(tmp_path))).where("sha256 IS NULL").count() == 0


# ---- windows ----------------------------------------------------------------------------

@pytest.mark.parametrize("block", [5, 16, 4096])
def test_stored_windows(spark, tmp_path, block):
    """Windows cut from stored runs equal those written out, for stations shorter than, as long as, and longer than a run."""
    rng = random.Random(9)
    lengths = {"a": 47, "b": 16, "c": 7, "d": 6, "e": 1, "f": 5}
    rows = [(k, datetime.date(2020, 1, 1) + datetime.timedelta(days=2 * i), None if rng.random() < 0.2 else rng.random(), rng.random())
            for k, n in lengths.items() for i in range(n)]
    df = spark.createDataFrame(rows, "clave_estacion string, fecha date, v double, w double").repartition(3)
    path = windows.write_windows(df, str(tmp_path / "w"), ["v", "w"], t_in=5, horizon=2, dtype="double", block=block)
    for t_in, horizon in ((5, 2), (3, 1)):
        want = features.build_windows_multi(df, ["w"], "v", t_in=t_in, horizon=horizon, dtype="double")
        got = windows.read_windows(spark, path, t_in, horizon, block=block)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect())) and want.count() > 0
    empty = windows.write_windows(df.limit(0), str(tmp_path / "none"), ["v", "w"], t_in=5, horizon=2)
    assert windows.read_windows(spark, empty, 5, 2).count() == 0


def test_stored_bytes_do_not_follow_the_window(spark, tmp_path):
    df = spark.range(6000).select((F.col("id") % 2).cast("string").alias("clave_estacion"), F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") / 2).cast("int")).alias("fecha"),
                                  F.rand(3).alias("v"), F.rand(4).alias("w"))
    size = {}
    for t_in in (8, 128):
        path = windows.write_windows(df, str(tmp_path / str(t_in)), ["v", "w"], t_in=t_in, horizon=7)
        size[t_in] = sum(p.stat().st_size for p in (tmp_path / str(t_in)).rglob("*.parquet"))
        assert windows.read_windows(spark, path, t_in, 7).count() == 2 * (3000 - t_in - 6)
    assert size[128] < 1.1 * size[8]
