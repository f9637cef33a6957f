"""Plans end to end over files, and the shape of the physical plans."""

import datetime as dt
import glob
import json
import re

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import calendar, features, gaps, neighbours, quality, raster, spatial
from gaugeline.plans import canonical, feature_table, report_metrics, selection
from gaugeline.sources import catalog_csv, series_csv, tables


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """Three flow and four rain stations over two years, with gaps and sentinels."""
    root = tmp_path_factory.mktemp("archive")
    start = dt.date(2020, 1, 1)

    def station(folder, key, header, step):
        lines = ["Estación: " + key, "", header]
        for i in range(0, 731):
            if i % step == 3 or 300 <= i < 312:
                continue
            value = "-9999" if i % 97 == 50 else f"{(i * 7 % 31) + 1}.5"
            lines.append(f"{start + dt.timedelta(days=i):%Y/%m/%d},{value}")
        path = root / folder
        path.mkdir(exist_ok=True)
        (path / f"{key}.csv").write_text("\n".join(lines), encoding="latin-1")

    for key, step in (("H1", 11), ("H2", 2), ("H3", 13)):
        station("flow", key, "Fecha,Gasto(m³/s)", step)
    for key in ("C1", "C2", "C3", "C4"):
        station("rain", key, "Fecha,Precipitación(mm)", 17)
    head = "Clave,Nombre,Latitud,Longitud,R.H.\n"
    (root / "h.csv").write_text(head + "H1,a,20.0,-100.0,12\nH2,b,21.0,-101.0,12\nH3,c,22.0,-99.0,10\n", encoding="latin-1")
    (root / "c.csv").write_text(head + "C1,a,20.1,-100.0,12\nC2,b,20.9,-101.0,18\nC3,c,25.0,-99.0,26\nC4,d,20.0,-100.1,12\n", encoding="latin-1")
    return root


def test_files_to_features(spark, archive, tmp_path):
    flow = canonical.run(spark, str(archive / "flow"), str(tmp_path / "flow"), "gasto_medio_m3s")
    rain = canonical.run(spark, str(archive / "rain"), str(tmp_path / "rain"), "precip_mm")
    hid, cli = tables.read_parquet(spark, flow), tables.read_parquet(spark, rain)
    h1 = hid.where("clave_estacion = 'H1'")
    assert h1.count() == 731 and hid.where("gasto_medio_m3s = -9999").count() == 0
    assert {r.fuente for r in hid.select("fuente").distinct().collect()} == {"SIH"}
    assert h1.where("gasto_medio_m3s IS NULL").count() == 5          # the gap of twelve, seven filled
    # A spline may swing below zero inside a gap; validation reports exactly those days.
    assert quality.validate_series(hid.drop("anio")).count() == hid.where("gasto_medio_m3s < 0 AND calidad = 1").count()

    sel = selection.select_stations(
        catalog_csv.read_catalog(spark, str(archive / "h.csv")), catalog_csv.read_catalog(spark, str(archive / "c.csv")),
        hid, cli, ("2020-01-01", "2021-12-31"), hydro_min=0.9, climate_min=0.5, extended_min=0.3, k=2)
    hydro = sel["hydro"].collect()
    assert [(r.clave, r.vecinos_clima) for r in hydro] == [("H1", "C4,C1"), ("H2", "C2,C1")]
    assert sel["extended"].count() == 0 and sel["climate"].count() == 4
    selection.write_selection(sel, str(tmp_path / "sel"))
    stations = catalog_csv.read_station_set(spark, str(tmp_path / "sel" / "estaciones_seleccionadas_hidrometricas.csv"))

    table = feature_table.build_features(selection.only_stations(hid, stations), "gasto_medio_m3s", cli, stations, sel["climate"])
    stats = table.groupBy("clave_estacion").agg(F.avg("gasto_medio_m3s").alias("m"), F.stddev("gasto_medio_m3s").alias("s"),
                                                F.count("precip_idw_mm").alias("n")).collect()
    assert all(r.m == pytest.approx(0, abs=1e-9) and r.s == pytest.approx(1) and r.n > 700 for r in stats) and len(stats) == 2
    tensors = feature_table.build_tensors(table, "gasto_medio_m3s", t_in=30, horizon=7)
    n = table.where("clave_estacion = 'H1'").count()
    assert tensors.where("clave_estacion = 'H1'").count() == n - 30 - 7 + 1
    first = tensors.first()
    assert len(first.X) == 30 and len(first.X[0]) == 9 and dict(tensors.dtypes)["X"].count("float") == 9


def test_metrics_sink(spark, archive, tmp_path):
    flow = tables.read_parquet(spark, canonical.run(spark, str(archive / "flow"), str(tmp_path / "f"), "gasto_medio_m3s"))
    rain = tables.read_parquet(spark, canonical.run(spark, str(archive / "rain"), str(tmp_path / "r"), "precip_mm"))
    catalog = catalog_csv.read_catalog(spark, str(archive / "h.csv"))
    rows = report_metrics.report_metrics(flow, rain, catalog, period=("2020-01-01", "2021-12-31"))
    tables.write_metrics(rows, str(tmp_path / "metrics"))
    written = [json.loads(x) for f in glob.glob(str(tmp_path / "metrics" / "*.json")) for x in open(f, encoding="utf-8")]
    value = {(m["section"], m["name"], m.get("key")): m["value"] for m in written}
    assert value["dataset", "n_estaciones", "hidrometricas"] == "3"
    assert value["precip_gasto", "lag_max_correlacion_dias", None] == "0"
    assert value["inventario", "n_estaciones", "12"] == "2"


def test_period_prunes_partitions(spark, archive, tmp_path):
    path = canonical.run(spark, str(archive / "flow"), str(tmp_path / "p"), "gasto_medio_m3s")
    df = calendar.in_period(tables.read_parquet(spark, path, ["clave_estacion", "fecha", "anio"]), "2021-03-01", "2021-04-30")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "anio" in plan.split("PartitionFilters: [")[1].split("]")[0] and "gasto" not in plan.split("ReadSchema")[1]
    assert df.count() == 3 * 61


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_one_exchange_serves_all_station_windows(spark):
    df = spark.range(2000).select(
        (F.col("id") % 20).cast("string").alias("clave_estacion"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 20).cast("int") * 2).alias("fecha"),
        (F.col("id") % 37).cast("double").alias("v"), F.lit("SIH").alias("fuente"))
    out = calendar.to_daily(df, unique=True)
    out = gaps.impute_short_gaps(quality.flag_outliers(out, "v"), "v", method="linear")
    out = features.normalize_per_station(features.add_rolling(features.add_lags(out, "v"), "v"), ["v"])
    plan = _final_plan(out)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "InPandas" not in plan


def _exchanges(df):
    return _final_plan(df).count("Exchange hashpartitioning")


def test_lines_are_not_shuffled_for_their_header(spark, archive):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as for tables beyond the static limit
    try:
        assert _exchanges(series_csv.read_series_csv(spark, str(archive / "flow"))) == 0
        pairs = spark.createDataFrame([("H1", "C1", 3.0), ("H1", "C2", 5.0)], "clave_estacion string, vecino string, dist_km double")
        rain = series_csv.read_series_csv(spark, str(archive / "rain"))
        assert _exchanges(neighbours.idw_to_station(pairs, rain)) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_cubic_gaps_need_one_exchange_and_five_windows(spark):
    df = spark.range(4000).select((F.col("id") % 20).cast("string").alias("clave_estacion"),
                                  F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 20).cast("int")).alias("fecha"),
                                  F.when(F.col("id") % 7 > 0, (F.col("id") % 37).cast("double")).alias("v"))
    plan = _final_plan(gaps.impute_short_gaps(df, "v"))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window") - plan.count("WindowGroupLimit") <= 5 and "Union" not in plan


def test_pointer_has_one_exchange(spark):
    px = spark.range(3000).select(F.lit("A").alias("basin"), (F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"),
                                  (F.col("id") * 7919 % 1009).cast("double").alias("z"))
    assert _exchanges(raster.d8_pointer(px)) == 1


def test_stages_from_paths(spark, archive, tmp_path):
    """Raw files to metrics, each stage from the paths that the one before wrote."""
    with pytest.warns(UserWarning, match="violations"):
        flow = canonical.run(spark, str(archive / "flow"), str(tmp_path / "flow"), ["nivel_m", "gasto_medio_m3s"])
    rain = canonical.run(spark, str(archive / "rain"), str(tmp_path / "rain"), ["precip_mm"])
    h, c = str(archive / "h.csv"), str(archive / "c.csv")
    period = ("2020-01-01", "2021-12-31")
    chosen = selection.run(spark, h, c, flow, rain, str(tmp_path / "sel"), period=period, hydro_min=0.9, climate_min=0.5, extended_min=0.3, k=2)
    out = feature_table.run(spark, flow, rain, chosen, str(tmp_path / "out"), t_in=30, horizon=7)
    assert {r.clave_estacion for r in spark.read.parquet(f"{out}/features").select("clave_estacion").distinct().collect()} == {"H1", "H2"}
    assert spark.read.parquet(f"{out}/windows").count() > 1000
    report_metrics.run(spark, flow, rain, h, str(tmp_path / "metrics"), period=period)
    written = [json.loads(x) for f in glob.glob(str(tmp_path / "metrics" / "*.json")) for x in open(f, encoding="utf-8")]
    assert any(m["section"] == "cobertura" for m in written)


@pytest.mark.parametrize("name", ["knn_stations", "assign_basin", "tiles_for_boxes", "describe", "exact_quantiles", "idw", "lagged_corr"])
def test_no_cross_joins(spark, name):
    import __spark_entry__ as entry
    plan = _final_plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_near_stations_are_dealt_by_count(spark, monkeypatch):
    """All levels may run in one stage: its tasks hold a bounded number of stations, however few bytes these have."""
    monkeypatch.setattr(neighbours, "_TARGETS_PER_TASK", 50)
    points = spark.range(401).select(F.col("id").cast("string").alias("clave"), (15 + F.col("id") % 17).alias("latitud"), (-115 + F.col("id") % 29).alias("longitud"))
    near = neighbours.nearest_stations(points, points)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "(clave, 9), REPARTITION_BY_NUM" in re.sub(r"#\d+", "", plan) and near.count() == 3 * 401


def test_boxes_are_moved_once_and_dealt_by_count(spark, monkeypatch):
    """A box is few bytes and much work: tasks hold a bounded number, and the points of its edges are moved once, not for each bound."""
    monkeypatch.setattr(spatial, "_BOXES_PER_TASK", 50)
    x, y = 1_500_000.0 + F.col("id") * 1000, 900_000.0 + F.col("id") * 500
    boxes = spark.range(401).select("id", x.alias("min_x"), y.alias("min_y"), (x + 1e5).alias("max_x"), (y + 1e5).alias("max_y"))
    moved = spatial.geographic_bounds(boxes)
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(9), REPARTITION_BY_NUM" in plan and plan.count("ATAN2") == 1 and moved.count() == 401


def test_table_by_station_needs_no_exchange(spark, tmp_path):
    """The stored layout serves windows, groups and joins by station, also in a session that only declares it."""
    df = spark.range(4000).select((F.col("id") % 40).cast("string").alias("clave_estacion"),
                                  F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 40).cast("int")).alias("fecha"), (F.col("id") % 37).cast("double").alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = tables.write_by_station(df, str(tmp_path / "t"), 4)
        other = tables.write_by_station(df.withColumnRenamed("v", "w"), str(tmp_path / "u"), 4)
        for session in (spark, spark.newSession()):
            session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
            one, two = tables.read_by_station(session, path, 4), tables.read_by_station(session, other, 4)
            out = features.normalize_per_station(features.add_rolling(features.add_lags(one, "v"), "v"), ["v"])
            assert _exchanges(out) == 0 and out.count() == 4000
            assert _exchanges(one.groupBy("clave_estacion").agg(F.avg("v"))) == 0
            assert _exchanges(one.join(two, ["clave_estacion", "fecha"])) == 0
        spark.sql(f"DROP TABLE {tables._table_name(path)}")       # as in a session that never wrote it; the files stay
        again = tables.read_by_station(spark, path, 4)
        assert _exchanges(features.add_lags(again, "v")) == 0 and again.exceptAll(df).count() == 0 and again.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert len([n for n in (tmp_path / "t").iterdir() if n.name.endswith(".parquet")]) <= 4
