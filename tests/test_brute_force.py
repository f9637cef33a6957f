"""Operators without a practical SQL form, against direct computation on small inputs."""

import datetime as dt
import hashlib
import math
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.functions.dates import mixed_date
from gaugeline.functions.gamma import gamma_cdf, normal_quantile
from gaugeline.functions.geo import lcc_xy, ring_area, within_ring
from gaugeline.functions.spline import cubic_at
from gaugeline.functions.stl import stl
from gaugeline.operators import climate, gaps, neighbours, raster, spatial
from gaugeline.operators.quantiles import exact_quantiles
from gaugeline.sources import inventory

# --- splines and gaps ---------------------------------------------------------------


def dense_spline(x, y, at):
    """Not-a-knot cubic by one dense system of polynomial coefficients."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0

    def terms(t, order):
        return {0: [1, t, t * t, t**3], 1: [0, 1, 2 * t, 3 * t * t], 2: [0, 0, 2, 6 * t], 3: [0, 0, 0, 6]}[order]

    for i in range(n):
        for k in (i, i + 1):
            a[row, 4 * i:4 * i + 4], b[row] = terms(x[k] - x[i], 0), y[k]
            row += 1
    for i in range(1, n):
        for order in (1, 2) + ((3,) if i in (1, n - 1) else ()):
            a[row, 4 * i - 4:4 * i] = terms(x[i] - x[i - 1], order)
            a[row, 4 * i:4 * i + 4] = [-v for v in terms(0.0, order)]
            row += 1
            if row == 4 * n:
                break
    c = np.linalg.lstsq(a, b, rcond=None)[0].reshape(n, 4)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    t = at - np.asarray(x)[i]
    return c[i, 0] + c[i, 1] * t + c[i, 2] * t**2 + c[i, 3] * t**3


@pytest.mark.parametrize("n", [4, 5, 6, 9, 25])
def test_spline(n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.integers(1, 5, n)).astype(float)
    at = np.linspace(x[0], x[-1], 41)
    cubic = 2 + 3 * x - 0.5 * x**2 + 0.01 * x**3
    assert np.allclose(cubic_at(x, cubic, at), 2 + 3 * at - 0.5 * at**2 + 0.01 * at**3, atol=1e-8)
    y = rng.normal(size=n)
    assert np.allclose(cubic_at(x, y, at), dense_spline(x, y, at), atol=1e-7)


def gap_series(spark, values, station="A"):
    return [(station, dt.date(2020, 1, 1) + dt.timedelta(days=i), v, 0) for i, v in enumerate(values)]


SCHEMA = "clave_estacion string, fecha date, v double, calidad int"


def test_gap_rules(spark):
    n = None
    a = [n, 1.0, 2.0, n, 4.0, n, n, n, n, n, n, n, 3.0, n, n, n, n, n, n, n, n, 5.0, 6.0, n]   # gaps of 1, 7, 8
    b = [1.0, n, 5.0, n, 2.0]                                                                # three points: lines
    df = spark.createDataFrame(gap_series(spark, a) + gap_series(spark, b, "B"), SCHEMA)
    got = gaps.impute_short_gaps(df, "v").orderBy("clave_estacion", "fecha").collect()
    out = [r.v for r in got if r.clave_estacion == "A"]
    known = [i for i, v in enumerate(a) if v is not None]
    fill = [3, *range(5, 12), *range(13, 20)]
    expected = dense_spline([float(i) for i in known], [a[i] for i in known], np.array(fill, float))
    assert np.allclose([out[i] for i in fill], expected, atol=1e-8)
    assert [i for i, v in enumerate(out) if v is None] == [0, 20, 23]
    assert [r.v for r in got if r.clave_estacion == "B"] == [1.0, 3.0, 5.0, 3.5, 2.0]
    assert [r.calidad for r in got if r.clave_estacion == "B"] == [0, 1, 0, 1, 0]
    whole = gaps.impute_short_gaps(df, "v", mode="whole").where("clave_estacion = 'A'").orderBy("fecha").collect()
    assert [i for i, r in enumerate(whole) if r.v is None] == [0, *range(13, 21), 23]


def test_linear_gaps_follow_pandas(spark):
    rng = random.Random(5)
    values = [None if rng.random() < 0.5 else rng.uniform(0, 9) for _ in range(300)]
    df = spark.createDataFrame(gap_series(spark, values), SCHEMA)
    got = [r.v for r in gaps.impute_short_gaps(df, "v", max_gap=3, method="linear").orderBy("fecha").collect()]
    want = pd.Series(values, dtype=float).interpolate("linear", limit=3, limit_area="inside")
    assert all((g is None and math.isnan(w)) or g == pytest.approx(w) for g, w in zip(got, want))


def test_imputed_outlier_keeps_its_flag(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, i + 1), v, q) for i, (v, q) in
                                enumerate([(1.0, 0), (None, 2), (3.0, 0), (None, None), (5.0, 0)])], SCHEMA)
    got = gaps.impute_short_gaps(df, "v", method="linear").orderBy("fecha").collect()
    assert [r.calidad for r in got] == [0, 2, 0, None, 0]


# --- distributions and decomposition ---------------------------------------------------


def test_gamma_and_normal():
    for a, x in ((0.3, 0.01), (0.5, 2.0), (2.5, 1.0), (2.5, 9.0), (40.0, 35.0), (40.0, 60.0)):
        if a < 1:   # substitution t = u^(1/a) takes the pole at zero away
            u = np.linspace(0, x ** a, 200001)
            f = np.exp(-(u ** (1 / a))) / a
        else:
            u = np.linspace(0, x, 200001)
            f = u ** (a - 1) * np.exp(-u)
        integral = ((f[1:] + f[:-1]) / 2 * np.diff(u)).sum() / math.gamma(a)
        assert gamma_cdf(np.array([a]), np.array([x]))[0] == pytest.approx(integral, abs=1e-6)
    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.999])
    cdf = [0.5 * math.erfc(-z / math.sqrt(2)) for z in normal_quantile(p)]
    assert np.allclose(cdf, p, rtol=1e-10)


def test_gamma_of_large_shapes():
    """P(a, a) = 1/2 + 1/(3 sqrt(2 pi a)) up to a term that falls with a^(3/2)."""
    a = np.array([5e4, 1e5, 3e5, 1e6])
    want = 0.5 + 1 / (3 * np.sqrt(2 * np.pi * a))
    assert np.allclose(gamma_cdf(a, a), want, rtol=0, atol=1e-9)
    x = np.array([1e6 - 3000, 1e6 - 1000, 1e6 + 1000, 1e6 + 3000])   # both branches, beside the normal limit
    z = 3 * math.sqrt(1e6) * ((x / 1e6) ** (1 / 3) - 1 + 1 / 9e6)     # Wilson and Hilferty
    assert np.allclose(gamma_cdf(np.full(4, 1e6), x), [0.5 * math.erfc(-v / math.sqrt(2)) for v in z], atol=1e-6)


def test_spi_gamma(spark):
    rng = np.random.default_rng(3)
    months = pd.date_range("1990-01-01", periods=240, freq="MS")
    rain = np.where(rng.random(240) < 0.6, 0.0, rng.gamma(2.0, 30.0, 240))
    df = spark.createDataFrame([("A", m.date(), float(r)) for m, r in zip(months, rain)],
                               "clave_estacion string, mes_inicio date, precip_mm double")
    for scale in (1, 3):
        got = [r[f"spi{scale}"] for r in climate.spi(df, scale=scale).orderBy("mes_inicio").collect()]
        s = pd.Series(rain).rolling(scale).sum()
        for i in (5, 77, 130, 239):
            same = s[(months.month == months[i].month) & s.notna()]
            pos = same[same > 0]
            skew = math.log(pos.mean()) - np.log(pos).mean()
            shape = (1 + math.sqrt(1 + 4 * skew / 3)) / (4 * skew)
            zero = (same == 0).mean()
            p = zero + (1 - zero) * gamma_cdf(np.array([shape]), np.array([s[i] * shape / pos.mean()]))[0]
            assert got[i] == pytest.approx(np.clip(normal_quantile(np.array([p]))[0], -3.09, 3.09), abs=1e-9)
        assert got[:scale - 1] == [None] * (scale - 1)


def test_stl_splits_a_known_signal(spark):
    n, period = 240, 12
    t = np.arange(n)
    trend, season = 5 + 0.05 * t, 3 * np.sin(2 * np.pi * t / period)
    tr, se, re = stl(trend + season, period)
    assert np.abs(tr - trend).max() < 0.1 and np.abs(se - season).max() < 0.1 and np.abs(re).max() < 0.1
    noisy = trend + season + np.random.default_rng(0).normal(0, 0.2, n)
    spiked = noisy.copy()
    spiked[100] += 50
    calm, hit, plain = stl(noisy, period), stl(spiked, period), stl(spiked, period, robust=False)
    assert hit[2][100] > 45 and np.abs(hit[0] - calm[0]).max() < 0.2      # the spike stays in the residual
    assert np.abs(plain[0] - calm[0]).max() > 1
    rows = [("A", dt.date(2000 + i // 12, i % 12 + 1, 1), None if i == 30 else float(v)) for i, v in enumerate(trend + season)]
    rows += [("B", dt.date(2000, i + 1, 1), 1.0) for i in range(12)]
    out = climate.stl_components(spark.createDataFrame(rows, "clave_estacion string, fecha date, v double"), "v", period)
    a = out.where("clave_estacion = 'A'")
    assert a.count() == n and a.where("abs(trend + seasonal + resid) > 0").count() == n
    assert out.where("clave_estacion = 'B' AND trend IS NULL").count() == 12


# --- quantiles -------------------------------------------------------------------------


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0, 100, 3000), "b": np.repeat([0.0, 7.0], [2000, 999]), "c": np.array([4.25]),
              "d": np.exp(rng.normal(0, 8, 500)) * rng.choice([-1, 1], 500), "e": 100 + rng.random(700) * 1e-9}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), (None, 3.0), ("z", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.999, 1.0]
    got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, "v", probs, ("g",)).collect()}
    assert len(got) == len(groups) * len(probs)
    for (g, p), q in got.items():
        assert q == pytest.approx(np.quantile(groups[g], p), rel=1e-12, abs=1e-300)
    everything = np.concatenate([*groups.values(), [3.0]])
    for r in exact_quantiles(df, "v", [0.5, 0.9]).collect():
        assert r.quantile == pytest.approx(np.quantile(everything, r.prob), rel=1e-12)


# --- nearest stations ------------------------------------------------------------------


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def check_nearest(spark, stations, others, k):
    schema = "clave string, latitud double, longitud double"
    out = neighbours.nearest_stations(spark.createDataFrame(stations, schema), spark.createDataFrame(others, schema), k)
    got = {}
    for r in out.collect():
        got.setdefault(r.clave, []).append((r.orden, r.vecino, r.dist_km))
    for key, lat, lon in stations:
        def dist(o):
            return None if None in (lat, lon, o[1], o[2]) else km(lat, lon, o[1], o[2])
        ranked = sorted(others, key=lambda o: ((d := dist(o)) is None, d or 0.0, o[0]))[:k]
        mine = sorted(got[key])
        assert [n for n, *_ in mine] == list(range(1, len(ranked) + 1))
        for (_, name, d), want in zip(mine, ranked):
            expected = dist(want)
            # Names may differ only where distances agree to rounding.
            assert (d is None) == (expected is None) and (d is None or d == pytest.approx(expected, abs=1e-6))
            assert name == want[0] or (d is not None and d == pytest.approx(dist(next(o for o in others if o[0] == name)), abs=1e-6))


def test_nearest_with_clusters_and_copies(spark):
    rng = random.Random(7)
    others = [(f"c{i:04d}", 20 + rng.gauss(0, 0.01), -100 + rng.gauss(0, 0.01)) for i in range(700)]      # one dense town
    others += [(f"d{i:04d}", 25.5, -105.5) for i in range(400)]                                            # copies of one place
    others += [(f"s{i:04d}", rng.uniform(14, 33), rng.uniform(-118, -86)) for i in range(300)]
    stations = [(f"h{i}", rng.uniform(14, 33), rng.uniform(-118, -86)) for i in range(40)]
    stations += [("in_town", 20.0, -100.0), ("by_town", 20.3, -100.2), ("at_copies", 25.5, -105.5), ("pole", 89.9, 10.0), ("other_side", -21.0, 80.0)]
    check_nearest(spark, stations, others, 3)


def test_nearest_without_positions(spark):
    others = [("b", 20.0, -100.0), ("a", None, -99.0), ("c", None, None), ("d", 21.0, -100.0)]
    stations = [("x", 20.5, -100.1), ("y", None, -100.0)]
    check_nearest(spark, stations, others, 3)
    check_nearest(spark, stations, others, 1)
    check_nearest(spark, stations, [("a", None, None), ("b", None, None)], 3)


# --- geometry ----------------------------------------------------------------------------


def test_lambert_against_the_published_example(spark):
    """EPSG guidance note 7-2, Lambert conic conformal (2SP): Texas South Central, in US survey feet."""
    texas = {"a": 6378206.4 / 0.3048006096012192, "inv_f": 294.97870, "lat0": 27 + 50 / 60, "lon0": -99.0,
             "lat1": 28 + 23 / 60, "lat2": 30 + 17 / 60, "false_easting": 2000000.0, "false_northing": 0.0}
    x, y = lcc_xy(F.lit(-96.0), F.lit(28.5), texas)
    out = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert out.x == pytest.approx(2963503.91, abs=0.02) and out.y == pytest.approx(254759.80, abs=0.02)


def test_ring_tests(spark):
    ell = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ell])
    closed = F.concat(ring, F.slice(ring, 1, 1))
    pts = [(1.0, 1.0, True), (3.0, 1.0, True), (3.0, 3.0, False), (1.0, 3.0, True), (5.0, 1.0, False), (-1.0, 2.0, False),
           (0.0, 1.0, False), (2.0, 3.0, False), (4.0, 2.0, False), (2.0, 2.0, False), (1.0, 2.0, True), (-1.0, 4.0, False)]
    df = spark.createDataFrame(pts, "x double, y double, want boolean")
    for r in (ring, closed):
        assert df.where(within_ring(F.col("x"), F.col("y"), r) != F.col("want")).count() == 0
        assert spark.range(1).select(ring_area(r)).first()[0] == 12.0


def test_assign_basin_with_sizes_and_overlaps(spark):
    rng = random.Random(2)
    boxes = [("big", -118.0, 14.0, 30.0)] + [(f"p{i}", rng.uniform(-110, -90), rng.uniform(15, 30), rng.choice([0.05, 0.5, 3.0])) for i in range(60)]
    rings = [(str(i % 3), n, [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]) for i, (n, x, y, s) in enumerate(boxes)]
    basins = spark.createDataFrame(rings, "region_hidrologica string, cuenca string, ring array<struct<x double, y double>>")
    pts = [(f"s{i}", rng.uniform(-120, -85), rng.uniform(12, 34)) for i in range(400)] + [("copy1", -100.0, 20.0), ("copy2", -100.0, 20.0), ("lost", None, 3.0)]
    stations = spark.createDataFrame(pts, "clave string, longitud double, latitud double")
    got = sorted((r.clave, r.cuenca or "") for r in spatial.assign_basin(stations, basins).collect())
    want = []
    for k, px, py in pts:
        hits = [n for n, x, y, s in boxes if px is not None and x < px < x + s and y < py < y + s]
        want += [(k, n) for n in hits] or [(k, "")]
    assert got == sorted(want)


def test_equal_polygons_are_tested_once(spark, monkeypatch):
    """Polygons of equal rings meet the places once, in tasks of a bounded number, and all of them get the hits."""
    monkeypatch.setattr(spatial, "_SHAPES_PER_TASK", 4)
    rings = [(f"b{i}", [[(x, 20.0), (x + 2, 20.0), (x + 2, 22.0), (x, 22.0)], [(x + .5, 20.5), (x + 1.5, 20.5), (x + 1.5, 21.5), (x + .5, 21.5)]])
             for i in range(60) for x in [-110.0 + i % 12]] + [("none", None)]
    basins = spark.createDataFrame(rings, "cuenca string, rings array<array<struct<x double, y double>>>")
    stations = spark.createDataFrame([(f"s{i}", -111.07 + (i % 50) * .3, 20.25 + (i % 3) * .6) for i in range(150)] + [("lost", None, None)],
                                     "clave string, longitud double, latitud double")
    found = spatial.assign_basin(stations, basins)
    want = []
    for k, px, py in [tuple(r) for r in stations.collect()]:
        hits = [n for n, r in rings if r and px is not None and sum(q[0][0] < px < q[2][0] and q[0][1] < py < q[2][1] for q in r) == 1]
        want += [(k, n) for n in hits] or [(k, None)]
    assert sorted(map(str, want)) == sorted(str((r.clave, r.cuenca)) for r in found.collect()) and len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(_shape#\d+, 4\), REPARTITION_BY_NUM", plan)    # 12 distinct ones and a null


# --- grids ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def dem():
    rng = np.random.default_rng(11)
    r, c = np.mgrid[0:37, 0:23]
    z = 5.0 * r + np.abs(c - 11) + rng.random((37, 23)) * 6
    z[5:8, 3:6] = np.nan
    z[20, 10:14] = 40.0   # a flat stretch: no way down between equals
    return z


def pixel_table(spark, z, basin="A"):
    rows = [(basin, int(r), int(c), None if np.isnan(z[r, c]) else float(z[r, c])) for r, c in np.ndindex(*z.shape)]
    return spark.createDataFrame(rows, "basin string, row int, col int, z double")


def test_sizes_are_the_basins_own(spark):
    rows = [(b, r, c, float(r * n + c)) for b, n in (("small", 4), ("large", 8)) for r in range(n) for c in range(n)]
    px = spark.createDataFrame(rows, "basin string, row int, col int, z double")
    got = {(r.basin, r.n) for r in raster.resample(px, 2.0).groupBy("basin").agg(F.count("*").alias("n")).collect()}
    assert got == {("small", 4), ("large", 16)}
    finer = {(r.basin, r.n) for r in raster.resample(px, 0.5).groupBy("basin").agg(F.count("*").alias("n")).collect()}
    assert finer == {("small", 64), ("large", 256)}


@pytest.mark.parametrize("tile", [2, 256])
def test_clipped_watershed_keeps_all_pixels(spark, tile):
    """Paths that leave the table have no outlet, in the tile they leave from and in the tiles above."""
    rows = [("A", 0, c, 0, c + 1) for c in range(5)]   # the last one points out of the table
    pointer = spark.createDataFrame(rows, "basin string, row int, col int, to_row int, to_col int")
    outlets = spark.createDataFrame([("g", "A", 0, 1)], "clave string, basin string, row int, col int")
    got = {(r.row, r.col): r.clave for r in raster.watershed(pointer, outlets, tile=tile).collect()}
    assert got == {(0, 0): "g", (0, 1): "g", (0, 2): None, (0, 3): None, (0, 4): None}
    assert raster.flow_accumulation(pointer, tile).count() == 5


@pytest.mark.parametrize("tile", [2, 256])
def test_cycles_raise(spark, tile):
    ring = [("A", 0, 1, 1, 2), ("A", 1, 2, 2, 1), ("A", 2, 1, 0, 1), ("A", 3, 3, 0, 1)]
    pointer = spark.createDataFrame(ring, "basin string, row int, col int, to_row int, to_col int")
    outlets = spark.createDataFrame([("g", "A", 3, 3)], "clave string, basin string, row int, col int")
    for run in (lambda: raster.flow_accumulation(pointer, tile).collect(), lambda: raster.watershed(pointer, outlets, tile=tile).collect()):
        with pytest.raises(Exception, match="cycle"):
            run()


def test_mixed_dates(spark):
    cases = {"15/03/2010": "2010-03-15", "03/15/2010": "2010-03-15", "01-Jan-2010": "2010-01-01", "2010/1/5": "2010-01-05", "March 7, 2011": "2011-03-07",
             "7 sept 2011": "2011-09-07", "20110907": "2011-09-07", "2011-09-07 10:00": "2011-09-07", "1 xyz 2010": None, "31/02/2010": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", mixed_date(F.col("t")).cast("string").alias("d"))
    assert {r.t: r.d for r in df.collect()} == cases


def test_rows_before_the_first_value_stay(spark):
    rows = [("A", i, None if i < 5 else float(i % 4)) for i in range(40)]
    out = climate.stl_components(spark.createDataFrame(rows, "clave_estacion string, fecha int, v double"), "v", 4).orderBy("fecha").collect()
    assert len(out) == 40 and all(r.trend is None for r in out[:5]) and all(r.trend is not None for r in out[5:])


def downstream(z):
    steps = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
    out = {}
    for r, c in np.ndindex(*z.shape):
        if np.isnan(z[r, c]):
            continue
        best = None
        for dr, dc in steps:
            rr, cc = r + dr, c + dc
            if 0 <= rr < z.shape[0] and 0 <= cc < z.shape[1] and z[rr, cc] < z[r, c]:
                fall = (z[r, c] - z[rr, cc]) / (math.sqrt(2) if dr and dc else 1)
                if best is None or fall > best[0]:
                    best = (fall, (rr, cc))
        out[r, c] = best[1] if best else None
    return out


@pytest.mark.parametrize("tile", [4, 9, 256])
def test_flow_and_watersheds(spark, dem, tile):
    flat = pixel_table(spark, dem).unionByName(pixel_table(spark, dem[::-1].copy(), "B"))
    pointer = raster.d8_pointer(flat)
    to = downstream(dem)
    got = {(r.row, r.col): None if r.to_row is None else (r.to_row, r.to_col) for r in pointer.where("basin = 'A'").collect()}
    assert got == to
    acc = dict.fromkeys(to, 0)
    for cell in to:
        at = cell
        while at is not None:
            acc[at] += 1
            at = to[at]
    out = raster.flow_accumulation(pointer, tile)
    assert {(r.row, r.col): r.acc for r in out.where("basin = 'A'").collect()} == acc
    sinks = out.join(pointer.where("to_row IS NULL"), ["basin", "row", "col"])
    assert sinks.agg(F.sum("acc")).first()[0] == 2 * len(to)

    outlets = [("u1", 0, 11), ("u2", 10, 11), ("u3", 15, 4), ("u4", 0, 11)]
    labels = {}
    for k, r, c in sorted(outlets):
        labels.setdefault((r, c), k)
    points = spark.createDataFrame([(k, "A", r, c) for k, r, c in outlets], "clave string, basin string, row int, col int")
    want = {}
    for cell in to:
        at = cell
        while at is not None and at not in labels:
            at = to[at]
        want[cell] = labels.get(at)
    sheds = raster.watershed(pointer, points, tile=tile)
    assert {(r.row, r.col): r.clave for r in sheds.where("basin = 'A'").collect()} == want

    attrs = {r.clave: r for r in raster.basin_attributes(sheds.join(flat, ["basin", "row", "col"]), 0.25).collect()}
    for k in set(want.values()) - {None}:
        cells = [c for c, v in want.items() if v == k]
        rows, cols = [c[0] for c in cells], [c[1] for c in cells]
        masked = np.full((max(rows) - min(rows) + 1, max(cols) - min(cols) + 1), np.nan)
        for r, c in cells:
            masked[r - min(rows), c - min(cols)] = dem[r, c]
        assert attrs[k].celdas == len(cells) and attrs[k].area_km2 == pytest.approx(len(cells) * 0.25)
        assert attrs[k].elevacion_media == pytest.approx(np.nanmean(masked))
        if min(masked.shape) > 1:
            gy, gx = np.gradient(masked)
            slope = np.degrees(np.arctan(np.hypot(gx, gy)))
            want_slope = None if np.isnan(slope).all() else np.nanmean(slope)
            assert attrs[k].pendiente_media == (None if want_slope is None else pytest.approx(want_slope))


def test_long_river(spark):
    """A path of a thousand cells over 125 tiles; everything ends in one cell."""
    z = np.arange(1000, dtype=float)[None, :]
    out = raster.flow_accumulation(raster.d8_pointer(pixel_table(spark, z)), 8)
    assert {r.col: r.acc for r in out.collect()} == {c: 1000 - c for c in range(1000)}


def test_snap(spark):
    streams = spark.createDataFrame([("A", 5, 5, 9), ("A", 5, 9, 9), ("A", 20, 20, 9), ("B", 5, 6, 9)], "basin string, row int, col int, acc long")
    pts = spark.createDataFrame([("p", "A", 5, 7), ("q", "A", 18, 19), ("far", "A", 40, 40), ("neg", "A", -1, 3)],
                                "clave string, basin string, row int, col int")
    got = {r.clave: (r.row, r.col) for r in raster.snap_points(pts, streams, 2.5).collect()}
    assert got == {"p": (5, 5), "q": (20, 20)}


def test_resample(spark):
    z = np.random.default_rng(4).random((7, 9))
    def run(scale):
        return {(r.row, r.col): r.z for r in raster.resample(
            pixel_table(spark, z), scale, spark.createDataFrame([("A", *z.shape)], "basin string, height int, width int")).collect()}
    coarse = run(2.0)
    assert set(coarse) == set(np.ndindex(3, 4))
    for (r, c), v in coarse.items():
        assert v == pytest.approx(z[2 * r:2 * r + 2, 2 * c:2 * c + 2].mean())
    third = run(1.5)
    assert set(third) == set(np.ndindex(4, 6))
    weights = np.array([1.0, 0.5])
    assert third[0, 0] == pytest.approx((z[:2, :2] * np.outer(weights, weights)).sum() / 2.25)
    fine = run(0.5)
    assert set(fine) == set(np.ndindex(14, 18))
    assert fine[0, 0] == pytest.approx(z[0, 0])
    assert fine[3, 4] == pytest.approx(0.75 * (0.75 * z[1, 2] + 0.25 * z[1, 1]) + 0.25 * (0.75 * z[2, 2] + 0.25 * z[2, 1]))


def test_mosaic_and_clip(spark):
    tiles = spark.createDataFrame([("b.tif", "A", 0, 0, 2.0), ("a.tif", "A", 0, 0, None), ("c.tif", "A", 0, 0, 3.0), ("c.tif", "A", 0, 1, 4.0)],
                                  "path string, basin string, row int, col int, z double")
    assert {(r.row, r.col): r.z for r in raster.mosaic(tiles).collect()} == {(0, 0): 2.0, (0, 1): 4.0}
    grid = pixel_table(spark, np.zeros((10, 10)))
    got = {(r.row, r.col) for r in raster.clip(grid, (2.0, 3.0, 5.0, 7.0), 0.0, 10.0, 1.0).collect()}
    assert got == {(r, c) for r in range(10) for c in range(10) if 2 <= c + 0.5 <= 5 and 3 <= 10 - (r + 0.5) <= 7}


# --- files -----------------------------------------------------------------------------------


def test_inventory(spark, tmp_path):
    for rel, data in (("raw/a.csv", b"12345"), ("raw/__pycache__/x.pyc", b"1"), ("features/t.npz", b"123"), ("features/f.parquet", b"1234567"),
                      ("interim/i.bin", b"12")):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    files = inventory.list_files(spark, str(tmp_path))
    rows = {r.path: r for r in inventory.manifest(inventory.bundle_files(files), os.path.basename(tmp_path)).collect()}
    assert set(rows) == {"raw/a.csv", "features/f.parquet", "interim/i.bin"}
    assert rows["raw/a.csv"].sha256 == hashlib.sha256(b"12345").hexdigest() and rows["raw/a.csv"].bytes == 5
    report = {r.zone: r for r in inventory.storage_report(files, cap_gb=12e-9).collect()}
    assert (report["features"].bytes, report["features"].bytes_no_npz) == (10, 7)
    # Spark lists no files below names that begin with an underscore or a dot.
    assert report[None].bytes_no_npz == 12 and report[None].over_cap is False
    assert [r.over_cap for r in inventory.storage_report(files, cap_gb=11e-9).where("zone IS NULL").collect()] == [True]
    assert inventory.manifest_summary(inventory.manifest(files)).first().n_files == 4
    assert len(inventory.first_records(inventory.manifest(files), 2).collect()) == 2
