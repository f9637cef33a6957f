"""Boxes, polygons and positions. Rings are ARRAY<STRUCT<x DOUBLE, y DOUBLE>>.

A polygon has one ``ring``, or ``rings`` with holes and parts (see ``functions.geo``).
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import (_edges, lcc_lonlat, lcc_ring, lcc_shape, lcc_xy, moved_edges, ring_area, ring_box, shape_area, shape_box, shape_edges,
                             within_edges)
from ..session import cut_lineage, join_small, stored


def bbox_from_latlon(df: DataFrame, margin_deg: float = 0.15, by: tuple[str, ...] = (),
                     lat: str = "latitud", lon: str = "longitud") -> DataFrame:
    """Bounding box with a margin, over everything or per group."""
    return df.groupBy(*by).agg(
        (F.min(lon) - margin_deg).alias("min_lon"), (F.min(lat) - margin_deg).alias("min_lat"),
        (F.max(lon) + margin_deg).alias("max_lon"), (F.max(lat) + margin_deg).alias("max_lat"))


def in_box(box: tuple[float, float, float, float], lat: str = "latitud", lon: str = "longitud") -> Column:
    """Inclusive test against (min_lon, min_lat, max_lon, max_lat)."""
    min_lon, min_lat, max_lon, max_lat = box
    return F.col(lon).between(min_lon, max_lon) & F.col(lat).between(min_lat, max_lat)


def in_named_boxes(df: DataFrame, boxes: list[tuple], lat: str = "latitud", lon: str = "longitud") -> DataFrame:
    """One row per station and configured box that holds it, as column ``cuenca``.

    ``boxes`` are (name, region, box, ...) entries of a configuration, so they are part
    of the plan; tables of boxes go through :func:`assign_basin`.
    """
    hits = F.array_compact(F.array(*[F.when(in_box(b[2], lat, lon), F.lit(b[0])) for b in boxes]))
    return df.where(reduce(or_, [in_box(b[2], lat, lon) for b in boxes])).withColumn("cuenca", F.explode(hits))


# --- point in polygon -------------------------------------------------------------

_FINEST = 20
# Rows are dealt to tasks by their number where each means much work: adaptive coalescing goes by the few bytes of a row.
_BOXES_PER_TASK = 1000     # a box has some hundred points to be moved
_SHAPES_PER_TASK = 200     # a shape is tested against all places in its box


def _cell_size(level) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _covering(shapes: DataFrame) -> DataFrame:
    """Each shape on the cells of its own level, chosen so that at most 4 by 4 cover its box."""

    def span(low: str, high: str) -> Column:
        s = _cell_size(F.col("_level"))
        return F.sequence(F.floor(F.col(f"_box.{low}") / s), F.floor(F.col(f"_box.{high}") / s))

    return (shapes.withColumn("_cx", F.explode(span("min_x", "max_x")))
            .withColumn("_cy", F.explode(span("min_y", "max_y"))))


def _shapes(named: DataFrame, form: str) -> DataFrame:
    """Distinct polygons by their digest ``_shape``, with edges, box and level."""
    shapes = named.dropDuplicates(["_shape"]).select("_shape", form)
    shapes = stored(shapes.withColumn("_box", shape_box(F.col(form)) if form == "rings" else ring_box(F.col(form)))
                    .withColumn(form, shape_edges(F.col(form)) if form == "rings" else _edges(F.col(form))), "shapes")
    extent = F.greatest(F.col("_box.max_x") - F.col("_box.min_x"), F.col("_box.max_y") - F.col("_box.min_y"), F.lit(1e-6))
    level = F.greatest(F.least(F.floor(F.log2(1080.0 / extent)), F.lit(_FINEST)), F.lit(0)).cast("int")
    return shapes.select("_shape", F.col(form).alias("_edges"), "_box", level.alias("_level"))


def assign_basin(stations: DataFrame, basins: DataFrame, basin_cols=("region_hidrologica", "cuenca"),
                 lat: str = "latitud", lon: str = "longitud") -> DataFrame:
    """Left join of stations with the polygons that contain them; several hits give several rows.

    Polygons and positions meet on grid cells, large polygons on coarse cells and small
    ones on fine cells, so a dense area does not pair all its points with all its
    polygons. Positions are matched once, however many stations share them, and so are polygons of equal rings.
    """
    cols = [c for c in basin_cols if c in basins.columns]
    form = "rings" if "rings" in basins.columns else "ring"
    named = basins.select(*[F.col(c).alias(f"_b_{c}") for c in cols], form, F.sha2(F.to_json(form), 256).alias("_shape"))
    shapes = _shapes(named, form)
    levels = shapes.agg(F.collect_set("_level")).scalar()   # at most 21 numbers
    places = (stations.select(F.col(lon).alias("_x"), F.col(lat).alias("_y"))
              .where(F.col("_x").isNotNull() & F.col("_y").isNotNull()).distinct())
    keyed = (places.select("_x", "_y", F.explode(levels).alias("_level"))
             .withColumn("_cx", F.floor(F.col("_x") / _cell_size(F.col("_level"))))
             .withColumn("_cy", F.floor(F.col("_y") / _cell_size(F.col("_level")))))
    x, y = F.col("_x"), F.col("_y")
    dealt = shapes.repartition(ceil(shapes.count() / _SHAPES_PER_TASK) or 1, "_shape")
    # the size on cells is not known from the polygons' bytes, so few places are sent to them and never they to the places
    inside = (join_small(_covering(dealt).hint("merge"), keyed, ["_level", "_cx", "_cy"])
              .where(x.between(F.col("_box.min_x"), F.col("_box.max_x"))
                     & y.between(F.col("_box.min_y"), F.col("_box.max_y")))
              .where(within_edges(x, y, F.col("_edges")))
              .select("_x", "_y", "_shape"))
    hits = join_small(inside, named.drop(form), "_shape").drop("_shape")
    kept = stations.select(*[c for c in stations.columns if c not in cols])
    return (kept.join(hits, (kept[lon] == hits["_x"]) & (kept[lat] == hits["_y"]), "left").drop("_x", "_y")
            .withColumnsRenamed({f"_b_{c}": c for c in cols}))


def reproject(df: DataFrame, lat: str = "latitud", lon: str = "longitud") -> DataFrame:
    """Metric coordinates ``x_m``, ``y_m`` of points."""
    x, y = lcc_xy(F.col(lon), F.col(lat))
    return df.withColumns({"x_m": x, "y_m": y})


def to_geographic(df: DataFrame, x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Degrees ``latitud``, ``longitud`` of points in metric coordinates."""
    lon, lat = lcc_lonlat(F.col(x), F.col(y))
    return df.withColumns({"longitud": lon, "latitud": lat})


_DEGREES, _METRES = ("min_lon", "min_lat", "max_lon", "max_lat"), ("min_x", "min_y", "max_x", "max_y")


def _moved(boxes: DataFrame, bounds: tuple[str, ...], move) -> DataFrame:
    """Boxes with ``_m``, their bounds after ``move``; points of the edges are moved once, and boxes dealt to tasks by their number."""
    boxes = cut_lineage(boxes)
    dealt = boxes.repartition(ceil(boxes.count() / _BOXES_PER_TASK) or 1)
    return dealt.withColumn("_points", moved_edges(*map(F.col, bounds), move)).withColumn("_m", ring_box(F.col("_points")))


def metric_bounds(boxes: DataFrame) -> DataFrame:
    """Adds min_x, min_y, max_x, max_y in metres to boxes in degrees."""
    return _moved(boxes, _DEGREES, lcc_xy).select(*boxes.columns, "_m.*")


def geographic_bounds(boxes: DataFrame) -> DataFrame:
    """Adds min_lon, min_lat, max_lon, max_lat to boxes in metres."""
    return _moved(boxes, _METRES, lcc_lonlat).select(*boxes.columns, *[F.col(f"_m.{a}").alias(b) for a, b in zip(_METRES, _DEGREES, strict=True)])


def with_area(basins: DataFrame, geographic: bool = True) -> DataFrame:
    """Polygon area in square kilometres; geographic rings are projected first."""
    if "rings" in basins.columns:
        return basins.withColumn("area_km2", shape_area(lcc_shape(F.col("rings")) if geographic else F.col("rings")) / 1e6)
    ring = lcc_ring(F.col("ring")) if geographic else F.col("ring")
    return basins.withColumn("area_km2", ring_area(ring) / 1e6)


def pour_points(stations: DataFrame, west: float, north: float, cell: float, key: str = "clave",
                lat: str = "latitud", lon: str = "longitud") -> DataFrame:
    """Stations as pixels (key, row, col) of a north-up grid."""
    return stations.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        key, F.floor((north - F.col(lat)) / cell).cast("int").alias("row"),
        F.floor((F.col(lon) - west) / cell).cast("int").alias("col"))


def tiles_for_boxes(tiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """(tile, box) pairs that touch. Both tables have min_lon, min_lat, max_lon, max_lat.

    Each side is put on cells of the size that suits it, at most 4 by 4, and on the coarser
    ones that the other side uses. A pair meets at the coarser of its two levels, so many small tiles
    and boxes in one place meet on small cells, and a large box has few cells. It is kept in
    the one cell that holds the lower left corner of its intersection.
    """
    def sized(df: DataFrame, prefix: str) -> DataFrame:
        named = df.withColumnsRenamed({c: f"{prefix}{c}" for c in ("min_lon", "min_lat", "max_lon", "max_lat")})
        extent = F.greatest(F.col(f"{prefix}max_lon") - F.col(f"{prefix}min_lon"), F.col(f"{prefix}max_lat") - F.col(f"{prefix}min_lat"), F.lit(1e-6))
        return named.withColumn(f"{prefix}own", F.greatest(F.least(F.floor(F.log2(1080.0 / extent)), F.lit(_FINEST)), F.lit(0)).cast("int"))

    def on_cells(df: DataFrame, prefix: str, other: Column) -> DataFrame:
        own = F.col(f"{prefix}own")
        # its own level, and the other side's levels above it
        levels = F.array_union(F.array(own), F.filter("_used", lambda level: level < own))
        leveled = df.withColumn("_used", other).withColumn("_level", F.explode(levels)).drop("_used")

        def span(axis: str) -> Column:
            s = _cell_size(F.col("_level"))
            return F.sequence(F.floor(F.col(f"{prefix}min_{axis}") / s), F.floor(F.col(f"{prefix}max_{axis}") / s))

        return leveled.withColumn("_cx", F.explode(span("lon"))).withColumn("_cy", F.explode(span("lat")))

    t, b = stored(sized(tiles, "_t_"), "tiles"), stored(sized(boxes, "_b_"), "boxes")
    used = {p: df.agg(F.collect_set(f"{p}own")).scalar() for p, df in (("_t_", t), ("_b_", b))}   # at most 21 numbers each
    pairs = on_cells(t, "_t_", used["_b_"]).join(on_cells(b, "_b_", used["_t_"]), ["_level", "_cx", "_cy"])
    low_x = F.greatest("_t_min_lon", "_b_min_lon")
    low_y = F.greatest("_t_min_lat", "_b_min_lat")
    touching = (low_x <= F.least("_t_max_lon", "_b_max_lon")) & (low_y <= F.least("_t_max_lat", "_b_max_lat"))
    size = _cell_size(F.col("_level"))
    here = (F.floor(low_x / size) == F.col("_cx")) & (F.floor(low_y / size) == F.col("_cy"))
    coarser = F.col("_level") == F.least("_t_own", "_b_own")
    return pairs.where(coarser & touching & here).select("tile", "cuenca")
