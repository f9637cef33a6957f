"""Statistics of a grid inside polygons.

Rings become row spans by scan conversion: every edge yields the places where it crosses the centre lines of
rows, so the work follows the length of the boundaries in rows, not edges times rows. Spans are cut at
column blocks and meet the pixels on (row, block), so a pixel is compared only with spans that
run through its own stretch of a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import _edges, shape_box, shape_edges
from .raster import CROSS, _around, with_slope
from .spatial import with_area

SPAN_COLS = 256


@dataclass(frozen=True)
class Grid:
    """A north-up grid: upper left corner and cell size, in the coordinates of the polygons."""

    west: float
    north: float
    cell: float


def _shapes(polygons: DataFrame, key: str) -> DataFrame:
    """Polygons with ``_edges`` and ``_box``, whether they have one ring or several."""
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    edges = shape_edges(rings) if "rings" in polygons.columns else _edges(F.col("ring"))
    return polygons.select(key, "basin", edges.alias("_edges"), shape_box(rings).alias("_box"))


def row_spans(polygons: DataFrame, grid: Grid, key: str = "clave") -> DataFrame:
    """(key, basin, row, first_col, last_col): pixels whose centres lie inside (key, basin, ring or rings).

    An edge belongs to the centre lines from its lower end up to, not including, its upper end, and a span to the
    centres from its left crossing up to, not including, its right one; so polygons that share a boundary share no pixel.
    """
    e = F.col("e")
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    # one row more on each side; the exact test follows
    rows = F.sequence(F.floor((grid.north - high) / grid.cell - 0.5).cast("int"), F.ceil((grid.north - low) / grid.cell - 0.5).cast("int"))
    yc = grid.north - (F.col("row") + 0.5) * grid.cell
    crossing = e["x1"] + (yc - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
    crossed = (_shapes(polygons, key).select(key, "basin", F.explode("_edges").alias("e")).where(e["y1"] != e["y2"])
               .select(key, "basin", "e", F.explode(rows).alias("row")).where((e["y1"] <= yc) != (e["y2"] <= yc))
               .groupBy(key, "basin", "row").agg(F.sort_array(F.collect_list(crossing)).alias("xs")))
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(xs) div 2 - 1")), lambda i: F.struct(F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b")))

    def first_centre(x):
        return F.ceil((x - grid.west) / grid.cell - 0.5).cast("int")

    return (crossed.select(key, "basin", "row", F.explode(pairs).alias("p"))
            .select(key, "basin", "row", first_centre(F.col("p.a")).alias("first_col"), (first_centre(F.col("p.b")) - 1).alias("last_col"))
            .where("first_col <= last_col"))


def pixels_in_polygons(pixels: DataFrame, polygons: DataFrame, grid: Grid, key: str = "clave") -> DataFrame:
    """(key, basin, row, col, z) for each pixel and polygon that holds its centre."""
    spans = row_spans(polygons, grid, key)
    cut = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first_col") / SPAN_COLS), F.floor(F.col("last_col") / SPAN_COLS))))
    placed = pixels.withColumn("_block", F.floor(F.col("col") / SPAN_COLS))
    return (placed.join(cut, ["basin", "row", "_block"]).where(F.col("col").between(F.col("first_col"), F.col("last_col")))
            .select(key, "basin", "row", "col", "z"))


def zonal_by_polygon(pixels: DataFrame, polygons: DataFrame, grid: Grid, key: str = "clave", geographic: bool = True, cell_size: float = 1.0) -> DataFrame:
    """(key, celdas, area_km2, elevacion_media, pendiente_media) of each polygon (key, basin, ring or rings).

    The area is the polygon's own, projected first where it is ``geographic``. Slopes in degrees are central
    differences between pixels of the polygon, one-sided on the edge of its window (the pixels its box touches, as far as the grid goes),
    missing where a neighbour lies outside the polygon or has no data. A lone pixel outside or without data, whose four
    neighbours are inside, has a slope too, as a central difference does not look at its centre. Polygons that hold no pixel with data
    have no means and zero cells. Keys must be unique; pixels must not repeat.
    """
    known = pixels.where(F.col("z").isNotNull())
    extent = pixels.groupBy("basin").agg(*[f(c).alias(n) for f, c, n in (
        (F.min, "row", "_top"), (F.max, "row", "_bottom"), (F.min, "col", "_left"), (F.max, "col", "_right"))])
    box, cell = F.col("_box"), grid.cell
    window = (_shapes(polygons, key).join(extent, "basin").select(
        key, "basin", F.greatest(F.floor((grid.north - box["max_y"]) / cell), "_top").alias("_r0"),
        F.least(F.ceil((grid.north - box["min_y"]) / cell) - 1, "_bottom").alias("_r1"),
        F.greatest(F.floor((box["min_x"] - grid.west) / cell), "_left").alias("_c0"),
        F.least(F.ceil((box["max_x"] - grid.west) / cell) - 1, "_right").alias("_c1")))
    inside = pixels_in_polygons(known, polygons, grid, key)
    stats = (with_slope(_around(inside, "z", (key,), CROSS, gaps=True).join(window, [key, "basin"]), cell_size).groupBy(key)
             .agg(F.count("z").alias("celdas"), F.avg("z").alias("elevacion_media"), F.avg("_s").alias("pendiente_media")))
    return (with_area(polygons, geographic).select(key, "area_km2").join(stats, key, "left")
            .select(key, F.coalesce("celdas", F.lit(0).cast("long")).alias("celdas"), "area_km2", "elevacion_media", "pendiente_media"))
