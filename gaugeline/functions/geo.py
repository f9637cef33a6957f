"""Geometry as column expressions. A ring is ARRAY<STRUCT<x DOUBLE, y DOUBLE>>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_KM, LCC_MEXICO


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance between two positions in degrees."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def _lcc_parameters(p: dict) -> tuple[float, float, float, float]:
    """Cone constant, scale factor, radius at the origin and eccentricity."""
    f = 1 / p["inv_f"]
    ecc = math.sqrt(2 * f - f * f)

    def m(lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (ecc * math.sin(lat)) ** 2)

    def t(lat: float) -> float:
        es = ecc * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - es) / (1 + es)) ** (ecc / 2)

    lat0, lat1, lat2 = (math.radians(p[k]) for k in ("lat0", "lat1", "lat2"))
    n = (math.log(m(lat1)) - math.log(m(lat2))) / (math.log(t(lat1)) - math.log(t(lat2)))
    scale = m(lat1) / (n * t(lat1) ** n)
    return n, scale, p["a"] * scale * t(lat0) ** n, ecc


def lcc_xy(lon: Column, lat: Column, params: dict = LCC_MEXICO) -> tuple[Column, Column]:
    """Lambert conformal conic with two standard parallels: easting and northing."""
    n, scale, rho0, ecc = _lcc_parameters(params)
    phi = F.radians(lat)
    es = ecc * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(ecc / 2))
    rho = params["a"] * scale * F.pow(t, F.lit(n))
    theta = n * F.radians(lon - params["lon0"])
    return (params["false_easting"] + rho * F.sin(theta),
            params["false_northing"] + rho0 - rho * F.cos(theta))


def lcc_lonlat(x: Column, y: Column, params: dict = LCC_MEXICO) -> tuple[Column, Column]:
    """The inverse: longitude and latitude in degrees.

    The latitude is iterated as an expression over a fixed list of seven steps after the first; each gains two digits or
    more, so that the last change is far below a micrometre.
    """
    n, scale, rho0, ecc = _lcc_parameters(params)
    east, south = x - params["false_easting"], rho0 - (y - params["false_northing"])
    t = F.pow(F.sqrt(east * east + south * south) / (params["a"] * scale), F.lit(1 / n))

    def better(phi: Column, t: Column) -> Column:
        es = ecc * F.sin(phi)
        return math.pi / 2 - 2 * F.atan(t * F.pow((1 - es) / (1 + es), F.lit(ecc / 2)))

    # the step from zero is that of a sphere; as elements of a list, t is computed once
    phi = F.aggregate(F.array_repeat(t, 8), F.lit(0.0), better)
    return params["lon0"] + F.degrees(F.atan2(east, south)) / n, F.degrees(phi)


def moved_edges(west: Column, south: Column, east: Column, north: Column, move, points: int = 21) -> Column:
    """Points of a box's edges after ``move`` (x, y), with so many put into each edge; ``ring_box`` gives their bounds.

    The edges of a box become curves, so its corners alone would not do.
    """
    share = F.transform(F.sequence(F.lit(0), F.lit(points + 1)), lambda i: i / (points + 1.0))

    def edge(f: Column) -> Column:
        x, y = west + f * (east - west), south + f * (north - south)
        return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, south), (x, north), (west, y), (east, y))])

    def placed(v: Column) -> Column:
        a, b = move(v["x"], v["y"])
        return F.struct(a.alias("x"), b.alias("y"))

    return F.transform(F.flatten(F.transform(share, edge)), placed)


def lcc_ring(ring: Column, params: dict = LCC_MEXICO) -> Column:
    def move(v: Column) -> Column:
        x, y = lcc_xy(v["x"], v["y"], params)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, move)


def _edges(ring: Column) -> Column:
    """Consecutive vertices as structs; a ring need not repeat its first vertex."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.zip_with(ring, shifted, lambda p, q: F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def ring_area(ring: Column) -> Column:
    """Unsigned planar area."""
    # Relative to the first vertex: keeps digits when coordinates are in the millions.
    o = F.get(ring, F.lit(0))
    twice = F.aggregate(
        _edges(ring), F.lit(0.0),
        lambda acc, e: acc + (e["x1"] - o["x"]) * (e["y2"] - o["y"])
        - (e["x2"] - o["x"]) * (e["y1"] - o["y"]))
    return F.abs(twice) / 2


def within_ring(x: Column, y: Column, ring: Column) -> Column:
    """True when the point lies strictly inside; a point on the boundary is outside."""
    return within_edges(x, y, _edges(ring))


def within_edges(x: Column, y: Column, edges: Column) -> Column:
    """The same for the edges of one or more rings: inside is where a ray crosses an odd number."""

    def cross(e: Column) -> Column:
        return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])

    on_edge = F.exists(edges, lambda e: (cross(e) == 0)
                       & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                       & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
    # An edge is crossed by the ray to the east when it spans y and lies right of x.
    crossings = F.size(F.filter(edges, lambda e: (
        ((e["y1"] > y) != (e["y2"] > y))
        & ((cross(e) > 0) == (e["y2"] > e["y1"])) & (cross(e) != 0))))
    return ~on_edge & (crossings % 2 == 1)


def ring_box(ring: Column) -> Column:
    xs = F.transform(ring, lambda v: v["x"])
    ys = F.transform(ring, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
                    F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


# --- several rings: holes, islands in holes, and parts -------------------------------
# A shape is ARRAY<ring>, in any order and direction. Rings do not cross; what lies inside an odd
# number of them belongs to the shape.


def shape_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, _edges))


def shape_box(rings: Column) -> Column:
    return ring_box(F.flatten(rings))


def within_shape(x: Column, y: Column, rings: Column) -> Column:
    return within_edges(x, y, shape_edges(rings))


def lcc_shape(rings: Column, params: dict = LCC_MEXICO) -> Column:
    return F.transform(rings, lambda ring: lcc_ring(ring, params))


def shape_area(rings: Column) -> Column:
    """Planar area: a ring inside an odd number of others is a hole and counts negative."""

    def signed(ring: Column, i: Column) -> Column:
        around = F.size(F.filter(rings, lambda other, j: (i != j) & F.exists(ring, lambda v: within_ring(v["x"], v["y"], other))))
        return F.when(around % 2 == 0, ring_area(ring)).otherwise(-ring_area(ring))

    return F.aggregate(F.transform(rings, signed), F.lit(0.0), lambda total, a: total + a)
