"""Hot keys, and the ways taken beyond the size limits."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline import session
from gaugeline.operators import calendar, neighbours, quantiles, report, spatial
from test_brute_force import check_nearest


def test_hot_station_is_reduced_before_any_station_window(spark):
    """A third of the raw rows belong to one station and one day; the daily table has one row for it."""
    raw = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("clave_estacion"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 20).cast("int").alias("d"), F.col("id").alias("v"))
    raw = raw.select("clave_estacion", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("fecha"), "v")
    one = calendar.unique_days(raw, ["v"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") >= 1 and "hashpartitioning(clave_estacion" in plan and ", fecha" in plan.split("hashpartitioning(clave_estacion")[1][:20]
    rows = {r.clave_estacion: r for r in one.where("clave_estacion = 'hot'").collect()}
    assert rows["hot"].v == 0 and one.count() == raw.select("clave_estacion", "fecha").distinct().count()


@pytest.mark.parametrize("limit", [0, 200_000])
def test_quantiles_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(9)
    groups = {"hot": np.repeat([0.5, 1.5, 2.5], 3000), "a": rng.gamma(1, 2, 400), "b": rng.normal(0, 1, 300)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    for r in quantiles.exact_quantiles(df, "v", [0.1, 0.5, 0.999], ("g",)).collect():
        assert r.quantile == pytest.approx(np.quantile(groups[r.g], r.prob), rel=1e-12)


@pytest.mark.parametrize("small", [20, 100_000])
def test_quantiles_of_data_far_from_zero(spark, monkeypatch, small):
    """All values share two buckets; they are cut again until no task orders more than a few."""
    monkeypatch.setattr(quantiles, "_SMALL", small)
    df = spark.range(0, 50_000, numPartitions=4).select(
        (F.col("id") % 2).alias("g"), (1900.0 + F.when(F.col("id") % 10 == 0, 0.25).otherwise((F.col("id") * 7919 % 50_000) / 100_000)).alias("v"))
    values = {g: np.array([r.v for r in df.where(F.col("g") == g).collect()]) for g in (0, 1)}
    for r in quantiles.exact_quantiles(df, "v", [0.0, 0.01, 0.5, 0.999, 1.0], ("g",)).collect():
        assert r.quantile == pytest.approx(np.quantile(values[r.g], r.prob), rel=1e-13)


def test_dense_town_beyond_the_first_levels(spark):
    """Thousands of places within some metres: the hierarchy goes on until its cells are small."""
    rng = random.Random(4)
    others = [(f"t{i:05d}", 19.5 + rng.random() * 2e-5, -99.5 + rng.random() * 2e-5) for i in range(3000)]
    stations = [(f"q{i}", 19.5 + rng.random() * 2e-5, -99.5 + rng.random() * 2e-5) for i in range(20)] + [("far", 25.0, -100.0)]
    check_nearest(spark, stations, others, 3)


def test_small_tiles_and_boxes_in_one_place(spark):
    rng = random.Random(5)

    def box(size):
        x, y = -99.5 + rng.random() * 0.5, 19.5 + rng.random() * 0.5
        return x, y, x + size * rng.random(), y + size * rng.random()

    tiles = [(f"t{i}", *box(0.004)) for i in range(1500)] + [("w", -180.0, -90.0, 180.0, 90.0), ("m", *box(3.0))]
    boxes = [(f"b{i}", *box(0.004)) for i in range(1500)] + [("W", -180.0, -90.0, 180.0, 90.0), ("M", *box(2.0)), ("p", -99.2, 19.7, -99.2, 19.7)]
    names = "string, min_lon double, min_lat double, max_lon double, max_lat double"
    got = spatial.tiles_for_boxes(spark.createDataFrame(tiles, f"tile {names}"), spark.createDataFrame(boxes, f"cuenca {names}")).collect()
    t, b = (np.array([x[1:] for x in rows]) for rows in (tiles, boxes))
    touch = ~((t[:, None, 2] < b[None, :, 0]) | (t[:, None, 0] > b[None, :, 2]) | (t[:, None, 3] < b[None, :, 1]) | (t[:, None, 1] > b[None, :, 3]))
    want = {(tiles[i][0], boxes[j][0]) for i, j in np.argwhere(touch)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_join_beyond_the_broadcast_limit(spark):
    left = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    side = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    a, b = (sorted(map(tuple, session.join_small(left, side, "k", rows=n).collect())) for n in (0, 100))
    assert a == b and len(a) == sum(1 for i in range(100) if i % 7 < 5)


def test_shared_rain_station_is_copied(spark, monkeypatch):
    rng = random.Random(1)
    pairs = spark.createDataFrame([(f"h{i}", v, rng.uniform(1, 50)) for i in range(60) for v in ("hot", f"c{i % 5}")],
                                  "clave_estacion string, vecino string, dist_km double")
    rain = spark.createDataFrame([(v, d, None if rng.random() < 0.2 else rng.uniform(0, 9)) for v in ["hot", *[f"c{j}" for j in range(5)]] for d in range(20)],
                                 "clave_estacion string, fecha int, precip_mm double")
    results = []
    for n, limit in ((1000, 200_000), (1000, 0), (7, 0)):   # broadcast pairs, then copies of the hot station
        monkeypatch.setattr(neighbours, "_TARGETS_PER_COPY", n)
        monkeypatch.setattr(neighbours, "BROADCAST_ROWS", limit)
        results.append({(r.clave_estacion, r.fecha): r.idw for r in neighbours.idw_to_station(pairs, rain).collect()})
    assert results[0].keys() == results[1].keys() and len(results[0]) == 60 * 20
    for other in results[1:]:
        assert all(v == pytest.approx(other[k]) if v is not None else other[k] is None for k, v in results[0].items())


def test_nearest_down_to_the_finest_cells(spark, monkeypatch):
    """A third of all places in one small town forces levels beyond the broadcast ones."""
    monkeypatch.setattr(neighbours, "_LEAF", 3)
    rng = random.Random(3)
    others = [(f"t{i:03d}", 19.5 + rng.random() * 0.002, -99.5 + rng.random() * 0.002) for i in range(100)]
    others += [(f"o{i:03d}", rng.uniform(14, 33), rng.uniform(-118, -86)) for i in range(200)]
    stations = [(f"q{i}", 19.5 + rng.random() * 0.004, -99.5 + rng.random() * 0.004) for i in range(10)]
    stations += [(f"r{i}", rng.uniform(14, 33), rng.uniform(-118, -86)) for i in range(10)]
    check_nearest(spark, stations, others, 4)


def test_hot_region_in_reports(spark):
    start = dt.date(2020, 1, 1)
    rows = [(f"s{i % 40}", "12" if i % 3 == 0 else str(i % 11), start + dt.timedelta(days=i // 40), float(i % 101)) for i in range(8000)]
    df = spark.createDataFrame(rows, "clave_estacion string, region_hidrologica string, fecha date, v double")
    got = {r.region_hidrologica: r for r in report.boxplot_by(df, "v").collect()}
    for region, r in got.items():
        values = np.array([x[3] for x in rows if x[1] == region])
        q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        assert (r.q1, r.median, r.q3, r.n) == (pytest.approx(q1), pytest.approx(q2), pytest.approx(q3), len(values))
        assert r.whisker_high == values[values <= q3 + 1.5 * (q3 - q1)].max()
