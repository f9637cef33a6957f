"""The published behaviour on small hand-made inputs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import calendar, features, gaps, neighbours, quality, report, spatial
from gaugeline.sources import catalog_csv, series_csv

D = dt.date


def days(n, start=D(2010, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture
def toy_series(spark):
    values = [4.5, None, 6.25, 7.0, 3.5, -9999.0, 2.0, 2.75, 8.0, 1.0]
    return spark.createDataFrame(
        [("R07", d, v, "SIH", 0) for d, v in zip(days(10, D(2016, 6, 3)), values)],
        "clave_estacion string, fecha date, gasto_medio_m3s double, fuente string, calidad int")


@pytest.fixture
def toy_report(spark):
    rows = [(st, rh, d, None if (i * 5 + k) % 17 == 0 else 40.0 - 2.5 * d.month, 1 if i % 90 == 7 else 0)
            for k, (st, rh) in enumerate((("K31", "18"), ("K32", "10"), ("K33", "10"), ("K34", "18"))) for i, d in enumerate(days(365, D(2015, 1, 1)))]
    return spark.createDataFrame(
        rows, "clave_estacion string, region_hidrologica string, fecha date, gasto_medio_m3s double, calidad int")


def test_bbox(spark):
    df = spark.createDataFrame([(17.25, -95.5), (None, -89.0), (16.5, -97.0), (19.75, -96.25)], "latitud double, longitud double")
    box = spatial.bbox_from_latlon(df, 0.5).first()
    assert (box.min_lon, box.min_lat, box.max_lon, box.max_lat) == (-97.5, 16.0, -88.5, 20.25)


def test_make_windows(spark):
    df = spark.createDataFrame([("W5", i, 100.0 - i, i * i / 4.0) for i in range(13)], "clave_estacion string, fecha int, a double, b double")
    rows = features.make_windows(df, ["a", "b"], t_in=4, horizon=3).orderBy("inicio").collect()
    assert len(rows) == 13 - 4 - 3 + 1 and all([len(x) for x in r.X] == [2] * 4 for r in rows)
    assert rows[2].y == 100.0 - 8 and [x.b for x in rows[2].X] == [1.0, 2.25, 4.0, 6.25]
    for n, expected in ((6, 0), (7, 1), (9, 3)):
        assert features.make_windows(df.where(F.col("fecha") < n), ["a"], t_in=4, horizon=3).count() == expected


def test_windows_keep_missing_inputs(spark):
    df = spark.createDataFrame([("A", i, None if i == 1 else float(i)) for i in range(5)],
                               "clave_estacion string, fecha int, a double")
    first = features.make_windows(df, ["a"], t_in=3, horizon=1).orderBy("inicio").first()
    assert [x.a for x in first.X] == [0.0, None, 2.0]


def test_add_lags(spark):
    flow = {"L1": [8.5, 7.25, None, 6.0], "L2": [0.5, 0.75]}
    df = spark.createDataFrame([(k, d, v) for k, vs in flow.items() for d, v in zip(days(4, D(2019, 2, 26)), vs)], "clave_estacion string, fecha date, v double")
    out = features.add_lags(df, "v", lags=(1, 2)).orderBy("clave_estacion", "fecha").collect()
    assert [(r.v_lag1, r.v_lag2) for r in out] == [(None, None), (8.5, None), (7.25, 8.5), (None, 7.25), (None, None), (0.5, None)]


def test_rolling_needs_half_a_window(spark):
    values = [1.0, None, None, 4.0, 5.0, 6.0, None, None]
    df = spark.createDataFrame([("A", d, v) for d, v in zip(days(8), values)],
                               "clave_estacion string, fecha date, v double")
    out = [r.v_ma7 for r in features.add_rolling(df, "v", windows=(7,)).orderBy("fecha").collect()]
    assert out[:4] == [None] * 4 and out[4] == pytest.approx(10 / 3) and out[6] == pytest.approx(4.0)


def test_normalize_constant_and_single(spark):
    rows = [("A", 1, 5.0), ("A", 2, 5.0), ("B", 1, 3.0), ("C", 1, 1.0), ("C", 2, 3.0)]
    df = spark.createDataFrame(rows, "clave_estacion string, fecha int, v double")
    out = {(r.clave_estacion, r.fecha): r.v for r in features.normalize_per_station(df, ["v"]).collect()}
    assert out["A", 1] == 0.0 and out["B", 1] is None
    assert out["C", 1] == pytest.approx(-(2 ** -0.5))


def _idw(spark, places, values, target=(10.0, -100.1)):
    stations = spark.createDataFrame([("H", *target, ",".join(k for k, *_ in places))],
                                     "clave string, latitud double, longitud double, vecinos_clima string")
    cat = spark.createDataFrame(places, "clave string, latitud double, longitud double")
    clim = spark.createDataFrame(values, "clave_estacion string, fecha int, precip_mm double")
    pairs = neighbours.neighbour_pairs(stations, cat)
    return {r.fecha: r.idw for r in neighbours.idw_to_station(pairs, clim).collect()}


def test_idw_renormalises(spark):
    """Two places at equal distance and one twice as far; a missing reading passes its weight on."""
    places = [("e", 0.0, -79.0), ("w", 0.0, -81.0), ("far", 0.0, -78.0)]
    out = _idw(spark, places, [("e", 1, 12.0), ("w", 1, 6.0), ("far", 1, 0.0), ("e", 2, None), ("w", 2, 5.5), ("far", 3, 2.25), ("e", 4, None)], (0.0, -80.0))
    assert out[1] == pytest.approx((12 + 6) / 2.25, rel=1e-4) and out[2] == pytest.approx(5.5) and out[3] == pytest.approx(2.25) and out[4] is None


def test_idw_at_distance_zero(spark):
    out = _idw(spark, [("n1", 10.0, -100.1), ("n2", 10.0, -100.2)], [("n1", 1, 7.0), ("n2", 1, 3.0)])
    assert out[1] == pytest.approx(7.0, abs=1e-6)


def test_build_windows_multi(spark):
    rows = [(st, d, 3.0 * i + k, 50.0 - i) for k, (st, n) in enumerate((("M1", 9), ("M2", 6), ("M3", 4))) for i, d in enumerate(days(n, D(2018, 5, 1)))]
    df = spark.createDataFrame(rows, "clave_estacion string, fecha date, gasto_medio_m3s double, gasto_medio_m3s_lag1 double")
    out = features.build_windows_multi(df, ["gasto_medio_m3s_lag1"], "gasto_medio_m3s", t_in=4, horizon=1).collect()
    assert sorted(r.clave_estacion for r in out) == ["M1"] * 5 + ["M2"] * 2 and all(len(r.X) == 4 and r.horizon == 1 for r in out)


def test_inventory(toy_report):
    inv = report.station_inventory(toy_report).collect()
    assert {r.region_hidrologica: r.n_estaciones for r in inv} == {"18": 2, "10": 2}
    assert report.station_inventory(toy_report, "no_such").first().n_estaciones == 4


def test_coverage(toy_report):
    cov = report.coverage_table(toy_report, "gasto_medio_m3s", start="2015-01-01", end="2015-12-31").collect()
    assert all(0 <= r.cobertura <= 1 and r.dias_periodo == 365 for r in cov)
    spans = report.coverage_table(toy_report.where("fecha >= date'2015-12-01'"), "gasto_medio_m3s", start="2015-01-01").collect()
    assert all(r.dias_periodo == 31 for r in spans)
    assert report.coverage_table(toy_report, "gasto_medio_m3s", start="2016-01-01", end="2016-12-31").count() == 0


def test_quality(toy_report):
    q = {r.calidad: r for r in report.quality_summary(toy_report).collect()}
    assert sum(r.pct for r in q.values()) == pytest.approx(100) and q[1].n >= 1 and q[2].n == 0
    empty = report.quality_summary(toy_report.where("false")).collect()
    assert [r.pct for r in empty] == [0.0, 0.0, 0.0]


def test_climatology(toy_report):
    mc = {r.mes: r for r in report.monthly_climatology(toy_report, "gasto_medio_m3s").collect()}
    assert len(mc) == 12 and mc[6]["mean"] == pytest.approx(25.0) and mc[6]["std"] == pytest.approx(0.0)


def test_lagged_corr(toy_report):
    out = {r.lag: r["corr"] for r in report.lagged_corr(toy_report, "gasto_medio_m3s", "gasto_medio_m3s", 3).collect()}
    assert abs(out[0] - 1) < 1e-9 and set(out) == {0, 1, 2, 3}


def test_lagged_corr_skips_constant_stations(spark):
    rows = [("A", i, 1.0, float(i)) for i in range(6)] + [("B", i, float(i), float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "clave_estacion string, fecha int, a double, b double")
    assert report.lagged_corr(df, "a", "b", 0).first()["corr"] == pytest.approx(1.0)


def test_sentinels(toy_series):
    out = quality.replace_sentinels(toy_series, ["gasto_medio_m3s", "precip_mm"])
    values = [r.gasto_medio_m3s for r in out.collect()]
    assert values.count(None) == 2 and -9999.0 not in values


@pytest.mark.parametrize("method", ["cubic", "linear"])
def test_imputation_marks_quality(toy_series, method):
    df = quality.replace_sentinels(toy_series, ["gasto_medio_m3s"])
    out = gaps.impute_short_gaps(df, "gasto_medio_m3s", method=method)
    assert out.where("calidad = 1").count() == 2
    assert quality.validate_series(out).count() == 0


def test_unknown_source_is_rejected(toy_series):
    bad = toy_series.withColumn("fuente", F.lit("DESCONOCIDA"))
    found = quality.validate_series(bad).where("column = 'fuente' and check = 'isin'")
    assert found.count() == 10
    with pytest.raises(quality.ValidationError):
        quality.validate_series(bad, strict=True)


def test_missing_columns_and_bad_casts_are_violations(spark):
    df = spark.createDataFrame([("A1", "2020-01-01", "x"), ("A1", "2020-13-01", "2.5")],
                               "clave_estacion string, fecha string, precip_mm string")
    found = {(r["column"], r["check"]) for r in quality.validate_series(df).collect()}
    assert {("fuente", "column_in_dataframe"), ("calidad", "column_in_dataframe"),
            ("precip_mm", "coerce(double)"), ("fecha", "coerce(timestamp)")} == found


# Header lines are the publisher's (fixed values); stations, days and readings are our own.
HYDRO_HEAD = "Fecha, Nivel(m), Gasto(m³/s)"
CLIMATE_HEAD = "Fecha,Precipitación(mm),Temperatura Media(ºC),Temperatura Máxima(ºC),Temperatura Mínima(ºC),Evaporación(mm)"
VARIANT_HEAD = "Estacion,Fecha,TempMax(C),Precipitacion(mm),TempMin(C),Evaporacion(mm),TempAmb(C)"


def station_file(head, *lines, notes=("Archivo de prueba", "Río Imaginario")):
    return "\n".join([*notes, "", head, *lines, ""])


HYDRO = station_file(HYDRO_HEAD, "2017/08/30,4.25,-", "2017/08/31,-,61.75")
CLIMATE = station_file(CLIMATE_HEAD, "2017/08/30,12.25,18.5,24.0,13.0,", "2017/08/31,0.75,-,-,-,")
VARIANT = station_file(VARIANT_HEAD, "Z9,2017-08-30,31.5,2.0,17.25,5.5,24.25", "Z9,2017-08-31,-,8.5,-,-,-", "Z9,sin dato,7,7,7,7,7")


@pytest.fixture(scope="module")
def raw_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in (("Q01", HYDRO), ("P02", CLIMATE), ("Z9", VARIANT), ("VACIO", "sin encabezado\n1,2\n")):
        (folder / f"{name}.csv").write_text(text, encoding="latin-1")
    return str(folder)


def test_series_files(spark, raw_folder):
    rows = series_csv.read_series_csv(spark, raw_folder).orderBy("clave_estacion", "fecha").collect()
    by = {(r.clave_estacion, r.fecha): r for r in rows}
    assert len(rows) == 6
    first, second = D(2017, 8, 30), D(2017, 8, 31)
    assert by["Q01", first].gasto_medio_m3s is None and by["Q01", first].nivel_m == 4.25
    assert by["Q01", second].gasto_medio_m3s == pytest.approx(61.75)
    assert by["P02", first].tmax_c == pytest.approx(24.0) and by["P02", first].evap_mm is None
    assert by["P02", second].precip_mm == pytest.approx(0.75)
    assert by["Z9", first].tmed_c == pytest.approx(24.25) and by["Z9", second].precip_mm == pytest.approx(8.5)


def test_files_without_header_are_listed(spark, raw_folder):
    lost = series_csv.files_without_header(series_csv.read_lines(spark, raw_folder)).collect()
    assert [os.path.basename(r.file) for r in lost] == ["VACIO.csv"]


def test_series_file_split_over_tasks(spark, tmp_path):
    body = "".join(f"{D(1900, 1, 1) + dt.timedelta(days=i):%Y/%m/%d},{i}.5,-\n" for i in range(20000))
    (tmp_path / "LARGO.csv").write_text("x\n2001/01/01,5,5\nFecha, Nivel(m), Gasto(m³/s)\n" + body, encoding="latin-1")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = series_csv.read_series_csv(spark, str(tmp_path))
        assert series_csv.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        out = df.agg(F.count("*").alias("n"), F.sum("nivel_m").alias("s"), F.min("fecha").alias("a")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert (out.n, out.a) == (20000, D(1900, 1, 1)) and out.s == pytest.approx(sum(i + 0.5 for i in range(20000)))


def test_bundled_series_files(spark, raw_folder, tmp_path):
    """Bundles give the rows and the lost files of the single files, and far fewer files; empty lines, quotes and blanks stay."""
    lines = series_csv.read_lines(spark, raw_folder)
    odd = spark.createDataFrame([("file:/ODD.csv", i, x) for i, x in enumerate(["", ' "á", b ', "Fecha,Gasto(m³/s)", "", '2020/01/02,"1.5"'])], "file string, id long, line string")
    odd = odd.select("file", F.struct(F.lit(0).cast("long").alias("offset"), "id").alias("pos"), "line")
    path = series_csv.write_bundle(lines.unionByName(odd), str(tmp_path / "bundle"))
    back = series_csv.read_bundle(spark, path)
    assert len(list((tmp_path / "bundle").glob("part-*"))) <= 4
    assert [r.line for r in back.where("file = 'file:/ODD.csv'").orderBy("pos").collect()] == ["", ' "á", b ', "Fecha,Gasto(m³/s)", "", '2020/01/02,"1.5"']
    got, want = series_csv.parse_series_lines(back), series_csv.read_series_csv(spark, raw_folder)
    assert got.where("clave_estacion <> 'ODD'").exceptAll(want).isEmpty() and got.count() == want.count() + 1
    assert [os.path.basename(r.file) for r in series_csv.files_without_header(back).collect()] == ["VACIO.csv"]


def test_catalogs(spark, tmp_path):
    (tmp_path / "h.csv").write_text(
        'Clave,Nombre de la estación,Latitud,Longitud,Altitud,Estado,Municipio,R.H.,Cuenca\n'
        'Q01,"Puente, el viejo",19.75,-99.5,2240,Hidalgo,Tula,26,Moctezuma\n', encoding="latin-1")
    (tmp_path / "c.csv").write_text(
        "Número,Clave ,Nombre,Latitud,Longitud,Altitud,Estado,Municipio,Id,Cuenca de disponibilidad,"
        "Número de la región hidrológica,Región hidrológica\n"
        "1,P02,Llano,20.5,-103.25,1600,Jal,Tala,77,Bordo,12,Cualquiera\n", encoding="latin-1")
    h = catalog_csv.read_catalog(spark, str(tmp_path / "h.csv")).first()
    assert h.region_hidrologica == "26" and h.latitud == pytest.approx(19.75) and h.nombre == "Puente, el viejo"
    c = catalog_csv.read_catalog(spark, str(tmp_path / "c.csv"))
    assert c.first().region_hidrologica == "12" and c.first().clave == "P02" and c.first().cuenca == "Bordo"
    assert catalog_csv.catalog_keys(c).first().clave == "P02"


def test_urls(spark):
    one = spark.range(1)
    assert one.select(series_csv.series_url("hidrometricas", F.lit("Q01"))).first()[0].endswith("/Hidros/Q01.csv")
    assert one.select(series_csv.series_url("climatologicas", F.lit("P02"))).first()[0].endswith("/Climas/P02.csv")


def test_station_set_keeps_leading_zeros(spark, tmp_path):
    df = spark.createDataFrame([("00123", 20.0, "a,b")], "clave string, latitud double, vecinos_clima string")
    catalog_csv.write_csv(df, str(tmp_path / "set"))
    back = catalog_csv.read_station_set(spark, str(tmp_path / "set")).first()
    assert (back.clave, back.latitud, back.vecinos_clima) == ("00123", 20.0, "a,b")


def test_calendar(spark):
    rows = [("A", D(2020, 1, 1), 1.0, "SIH"), ("A", D(2020, 1, 4), 4.0, "SIH"), ("A", D(2020, 1, 4), 9.0, "SIH"),
            ("B", D(2020, 1, 2), 2.0, "SIH")]
    df = spark.createDataFrame(rows, "clave_estacion string, fecha date, v double, fuente string")
    out = calendar.to_daily(df).orderBy("clave_estacion", "fecha").collect()
    assert [(r.clave_estacion, r.fecha.day, r.v) for r in out] == [
        ("A", 1, 1.0), ("A", 2, None), ("A", 3, None), ("A", 4, 4.0), ("B", 2, 2.0)]
    assert all(r.fuente == "SIH" for r in out)


def test_outliers(spark):
    values = [1.0] * 2999 + [-1.0] + [50.0]
    df = spark.createDataFrame([("A", d, v) for d, v in zip(days(3001), values)],
                               "clave_estacion string, fecha date, v double")
    out = quality.flag_outliers(df, "v").where("calidad = 2").collect()
    assert sorted(r.v for r in out) == [-1.0, 50.0]
    empty = spark.createDataFrame([("A", D(2020, 1, 1), None)], "clave_estacion string, fecha date, v double")
    assert quality.flag_outliers(empty, "v").first().calidad == 0


def test_cross_source_needs_ten_days(spark):
    def source(n, shift):
        return spark.createDataFrame([(st, d, float(i) + shift) for st, k in (("A", n), ("B", 9)) for i, d in enumerate(days(k))],
                                     "clave_estacion string, fecha date, v double")
    out = report.cross_source_agreement(source(10, 1.0), source(12, 0.0), "v").collect()
    assert [(r.clave_estacion, r.n) for r in out] == [("A", 10)]
    assert out[0]["corr"] == pytest.approx(1) and out[0].sesgo == pytest.approx(1)
