"""The given tables seen as station series, catalogues, grids and polygons.

Views read whole tables; the two networks are events of their own kinds. Daily views aggregate on (station, day), so their
keys are unique and the operators' ``unique=True`` holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.operators.calendar import to_daily

GRID_COLS = 40
# Unit factors; they also keep averages of two-decimal inputs off exact rounding ties.
CUBIC_FOOT = 0.028316846592
SURVEY_FOOT = 1200.0 / 3937.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_day(events: DataFrame, value: str, prefix: str = "") -> DataFrame:
    return events.groupBy(F.concat(F.lit(prefix), F.col("user_id").cast("string")).alias("clave_estacion"),
                          F.col("ts").cast("date").alias("fecha")).agg((F.avg("value") * CUBIC_FOOT).alias(value))


def daily(spark, sf_dir) -> DataFrame:
    return _by_day(table(spark, sf_dir, "events"), "v")


def _network(spark, sf_dir, kinds, value, prefix="") -> DataFrame:
    return _by_day(table(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds)), value, prefix)


def hydro(spark, sf_dir) -> DataFrame:
    """The flow network: two kinds of event."""
    return (_network(spark, sf_dir, ("purchase", "click"), "gasto_medio_m3s")
            .withColumn("fuente", F.lit("SIH")).withColumn("calidad", F.lit(0)))


def climate(spark, sf_dir) -> DataFrame:
    """The rain network, sparse."""
    return _network(spark, sf_dir, ("view",), "precip_mm", "C")


def source_b(spark, sf_dir) -> DataFrame:
    """A second source of flow."""
    return _network(spark, sf_dir, ("signup",), "gasto_medio_m3s")


def flow(spark, sf_dir) -> DataFrame:
    """Six years of daily flow per nation, with negative values and spikes."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    value = F.when(F.col("o_orderkey") % 997 == 0, F.col("o_totalprice") / 50.0).otherwise(F.col("o_totalprice") / 1000.0)
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("clave_estacion"),
                     F.col("o_orderdate").cast("date").alias("fecha"))
            .agg((F.avg(value) * CUBIC_FOOT - 0.6).alias("gasto_medio_m3s")))


def monthly(spark, sf_dir) -> DataFrame:
    """Monthly sums per nation, one row per month that has orders."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("clave_estacion"),
                     F.trunc("o_orderdate", "month").alias("mes_inicio"))
            .agg((F.sum("o_totalprice") / 1e6).alias("precip_mm"), (F.count("*") * 0.1).alias("pet_mm")))


def _regions(key):
    return (F.when(key % 4 == 0, "12").when(key % 4 == 1, "18").when(key % 4 == 2, "26").otherwise("10"))


def catalog(spark, sf_dir) -> DataFrame:
    u = F.col("user_id")
    return (table(spark, sf_dir, "events").select("user_id").distinct()
            .select(u.cast("string").alias("clave"), F.concat(F.lit("Estacion "), u.cast("string")).alias("nombre"),
                    (14 + ((u * 37) % 190) / 10.0).alias("latitud"),
                    (-118.5 + ((u * 53) % 325) / 10.0).alias("longitud"),
                    ((u * 13) % 3000).cast("double").alias("altitud"),
                    F.concat(F.lit("E"), (u % 32).cast("string")).alias("estado"),
                    _regions(u).alias("region_hidrologica")))


def climate_catalog(spark, sf_dir) -> DataFrame:
    u = F.col("user_id")
    return (table(spark, sf_dir, "events").select("user_id").distinct()
            .select(F.concat(F.lit("C"), u.cast("string")).alias("clave"),
                    (14 + ((u * 41) % 1900) / 100.0).alias("latitud"),
                    (-118.5 + ((u * 59) % 3250) / 100.0).alias("longitud"),
                    _regions(u).alias("region_hidrologica")))


def pixels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.lit("A").alias("basin"), F.expr(f"int(p_partkey div {GRID_COLS})").alias("row"),
        F.expr(f"int(p_partkey % {GRID_COLS})").alias("col"),
        (F.col("p_retailprice") + F.col("p_size") * 0.2).alias("z"))


def flat_pixels(spark, sf_dir) -> DataFrame:
    """The grid in steps of twelve units: terraces, with hollows."""
    return pixels(spark, sf_dir).withColumn("z", F.floor(F.col("z") / 12).cast("double"))


def two_grids(spark, sf_dir) -> DataFrame:
    """The grid of parts, and one of another size from the suppliers."""
    small = table(spark, sf_dir, "supplier").select(
        F.lit("B").alias("basin"), F.expr("int(s_suppkey div 3)").alias("row"), F.expr("int(s_suppkey % 3)").alias("col"),
        (F.col("s_suppkey") * 1.7 + F.col("s_nationkey")).alias("z"))
    return pixels(spark, sf_dir).unionByName(small)


def dated_text(spark, sf_dir) -> DataFrame:
    """Days of events in the notations that files mix."""
    ts, n = F.col("ts"), F.col("event_id") % 7
    day_first = F.when(F.dayofmonth(ts) > 12, F.date_format(ts, "dd/MM/yyyy")).otherwise(F.date_format(ts, "M/d/yyyy"))
    return table(spark, sf_dir, "events").select("event_id", F.when(n == 0, F.date_format(ts, "yyyy/MM/dd")).when(n == 1, F.date_format(ts, "yyyyMMdd"))
        .when(n == 2, day_first).when(n == 3, F.date_format(ts, "dd-MMM-yyyy")).when(n == 4, F.date_format(ts, "MMMM d, yyyy"))
        .when(n == 5, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("sin fecha")).alias("text"))


def tiles(spark, sf_dir) -> DataFrame:
    """Seven overlapping tiles; a tile has one value per pixel it covers."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.concat(F.lit("tile_"), F.col("l_linenumber").cast("string")).alias("path"), "l_partkey")
            .agg((F.avg(F.col("l_extendedprice") / 1000.0) * SURVEY_FOOT).alias("z"))
            .select("path", F.lit("A").alias("basin"), F.expr(f"int(l_partkey div {GRID_COLS})").alias("row"),
                    F.expr(f"int(l_partkey % {GRID_COLS})").alias("col"), "z"))


def outlets(spark, sf_dir) -> DataFrame:
    """One gauge per supplier on the grid."""
    at = F.col("s_suppkey") * 19
    return table(spark, sf_dir, "supplier").select(
        F.format_string("S%06d", "s_suppkey").alias("clave"), F.lit("A").alias("basin"),
        F.expr(f"int((s_suppkey * 19) div {GRID_COLS})").alias("row"), (at % GRID_COLS).cast("int").alias("col"))


def polygons(spark, sf_dir) -> DataFrame:
    """A square or an L-shape of two degrees per supplier."""
    k = F.col("s_suppkey")
    x = -118.5 + ((k * 53) % 325) / 10.0 - 0.95
    y = 14 + ((k * 37) % 190) / 10.0 - 0.95

    def vertex(dx, dy):
        return F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))

    square = F.array(*[vertex(*v) for v in ((0., 0.), (2., 0.), (2., 2.), (0., 2.))])
    ell = F.array(*[vertex(*v) for v in ((0., 0.), (2., 0.), (2., 1.), (1., 1.), (1., 2.), (0., 2.))])
    return (table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", x.alias("x0"), y.alias("y0"))
            .select(F.col("s_nationkey").cast("string").alias("region_hidrologica"), F.col("s_name").alias("cuenca"),
                    F.when(k % 2 == 0, square).otherwise(ell).alias("ring")))


# Rings of the multi-ring polygons, as offsets in degrees: a square with a hole and an island in it, and a part of its own.
SHAPE = (((0., 0.), (2., 0.), (2., 2.), (0., 2.)), ((.5, .5), (.5, 1.5), (1.5, 1.5), (1.5, .5)), ((.8, .8), (1.2, .8), (1.2, 1.2), (.8, 1.2)),
         ((2.5, 0.), (3.2, 0.), (3.2, .6)))
# Of the polygons on the grid: a rhombus with a hole, and a triangle beside it.
PLOT = (((0., -.15), (.21, 0.), (.42, -.15), (.21, -.33)), ((.15, -.12), (.27, -.12), (.27, -.21), (.15, -.21)), ((.5, 0.), (.62, -.02), (.55, -.2)))
GRID = (-100.5, 20.0, 0.03)


def _rings(offsets, x0: str, y0: str):
    return F.array(*[F.array(*[F.struct((F.col(x0) + dx).alias("x"), (F.col(y0) + dy).alias("y")) for dx, dy in ring]) for ring in offsets])


def shapes(spark, sf_dir) -> DataFrame:
    """A polygon of four rings per supplier."""
    k = F.col("s_suppkey")
    return (table(spark, sf_dir, "supplier").withColumns({"x0": -118.5 + ((k * 53) % 325) / 10.0 - 0.95, "y0": 14 + ((k * 37) % 190) / 10.0 - 0.95})
            .select(F.col("s_nationkey").cast("string").alias("region_hidrologica"), F.col("s_name").alias("cuenca"), _rings(SHAPE, "x0", "y0").alias("rings")))


def plots(spark, sf_dir) -> DataFrame:
    """A polygon of three rings per supplier on the grid of parts."""
    k = F.col("s_suppkey")
    return (table(spark, sf_dir, "supplier").withColumns({"x0": -100.4893 + ((k * 7) % 30) * 0.03, "y0": 19.9887 - ((k * 11) % 40) * 0.03})
            .select(F.format_string("S%06d", "s_suppkey").alias("clave"), F.lit("A").alias("basin"), _rings(PLOT, "x0", "y0").alias("rings")))


def frames(spark, sf_dir) -> DataFrame:
    """Origin and cell of the seven tiles, all different."""
    k = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().select(
        F.concat(F.lit("tile_"), k.cast("string")).alias("path"), F.lit("A").alias("basin"), (-100.5 + (k - 1) * 0.0413).alias("west"),
        (20.0 + (k - 1) * 0.0277).alias("north"), (0.03 * (1 + (k % 3) * 0.5)).alias("cell"))


def metric_tiles(spark, sf_dir) -> DataFrame:
    """A box of 150 km per supplier, in metres."""
    k = F.col("s_suppkey")
    low_x, low_y = 1_200_000.0 + (k * 53 % 325) * 9000.0, 400_000.0 + (k * 37 % 190) * 9000.0
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("tile"), low_x.alias("min_x"), low_y.alias("min_y"),
                                                   (low_x + 150_000.0).alias("max_x"), (low_y + 150_000.0).alias("max_y"))


METRIC_GRID = (2_650_000.0, 880_000.0, 3000.0)
METRIC_BOXES = (("A", -100.2, 19.2, -99.7, 19.8), ("B", -100.6, 19.1, -100.47, 19.9))


def raw_lines(spark, sf_dir) -> DataFrame:
    """Flow series written back as station files: metadata, header, one line per calendar day."""
    days = to_daily(hydro(spark, sf_dir), unique=True)
    value = F.coalesce(F.round("gasto_medio_m3s", 4).cast("string"), F.lit("-"))
    data = F.struct((F.datediff("fecha", F.lit("1970-01-01").cast("date")) + 100).alias("n"),
                    F.concat(F.date_format("fecha", "yyyy/MM/dd"), F.lit(",-,"), value).alias("line"))
    head = ["Comisión Nacional", "Estación: de prueba", "Estado: ninguno", "", "Fecha, Nivel(m), Gasto(m³/s)"]
    heads = [F.struct(F.lit(i).alias("n"), F.lit(text).alias("line")) for i, text in enumerate(head)]
    first = F.lag("fecha").over(Window.partitionBy("clave_estacion").orderBy("fecha")).isNull()
    lines = days.withColumn("first", first).select(
        F.concat(F.lit("file:/raw/Hidros/"), F.col("clave_estacion"), F.lit(".csv")).alias("file"),
        F.inline(F.when(F.col("first"), F.array(*heads, data)).otherwise(F.array(data))))
    return lines.select("file", F.struct(F.lit(0).cast("long").alias("offset"), F.col("n").cast("long").alias("id")).alias("pos"), "line")


def raw_catalog(spark, sf_dir) -> DataFrame:
    """The catalogue as text under the publisher's headers."""
    c = catalog(spark, sf_dir)
    pad = F.lit(" ")
    return c.select(
        F.lit("1").alias("Número"), F.concat(pad, "clave", pad).alias("Clave "), F.col("nombre").alias("Nombre de la estación"),
        F.col("latitud").cast("string").alias("Latitud"), F.col("longitud").cast("string").alias("Longitud"),
        F.when(F.col("altitud") > 2500, "s/d").otherwise(F.col("altitud").cast("string")).alias("Altitud"),
        F.col("estado").alias("Estado"), F.concat("region_hidrologica", pad).alias("R.H."))


def messy_series(spark, sf_dir) -> DataFrame:
    """Event records with broken keys, sources, flags and ranges."""
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.when(u % 10 == 0, F.concat(F.lit("no valida "), u.cast("string"))).otherwise(u.cast("string")).alias("clave_estacion"),
        F.col("ts").cast("date").alias("fecha"), (F.col("value") - 5.0).alias("gasto_medio_m3s"),
        F.col("value").alias("tmax_c"), F.when(F.col("event_type") == "error", "OTRA").otherwise("CLICOM").alias("fuente"),
        (F.col("event_id") % 4).cast("int").alias("calidad"))


def messy_catalog(spark, sf_dir) -> DataFrame:
    """One row per customer, keyed by nation and thus repeated, with positions out of range."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.when(F.col("c_nationkey") == 3, F.lit("llave muy larga")).otherwise(
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("clave"),
        (10 + (k % 25)).cast("double").alias("latitud"), (-120.0 + (k % 40)).alias("longitud"),
        (F.col("c_acctbal") / 10).alias("altitud"))
