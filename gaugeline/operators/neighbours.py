"""Nearest stations and inverse-distance weighting."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DAY, STATION
from ..functions.geo import haversine_km
from ..session import BROADCAST_ROWS, cut_lineage

_SPLIT = 2            # bits per axis and level: a cell has 16 children
_LEVELS = 15          # finest cell: some centimetres
_FIRST_LEVELS = 9     # 0.0014 by 0.0007 degrees; finer ones only where such a cell is still full
_LEAF = 64            # stop refining once no cell holds more places
_BOUNDED_LEVEL = 4    # level n has at most 16**n cells, so up to here the table is small
_SLACK_KM = 1e-6
_TARGETS_PER_COPY = 1000
_TARGETS_PER_TASK = 2000   # a station has some hundred rows on its way down, more than its bytes tell


def _axis(deg: Column, span: float) -> Column:
    n = 1 << (_SPLIT * _LEVELS)
    return F.least(F.greatest(F.floor((deg + span / 2) / span * n), F.lit(0)), F.lit(n - 1)).cast("long")


def _cell(level: int) -> Column:
    shift = _SPLIT * (_LEVELS - level)
    return F.shiftleft(F.shiftright("ix", shift), 32).bitwiseOR(F.shiftright("iy", shift))


def _centre(cell: Column, level: int) -> tuple[Column, Column]:
    n = float(1 << (_SPLIT * level))
    lon = (F.shiftright(cell, 32) + 0.5) / n * 360 - 180
    lat = (cell.bitwiseAND(F.lit((1 << 32) - 1)) + 0.5) / n * 180 - 90
    return lat, lon


def _places(others: DataFrame, key: str, k: int) -> DataFrame:
    """Keys with their position on the grid; of those at one position only the first k can matter."""
    same = Window.partitionBy("v_lat", "v_lon").orderBy("vecino")
    lat, lon = (F.when(F.col("latitud").isNotNull() & F.col("longitud").isNotNull(), F.col(c))
                for c in ("latitud", "longitud"))
    return (others.where(F.col(key).isNotNull())
            .select(F.col(key).alias("vecino"), lat.alias("v_lat"), lon.alias("v_lon"))
            .withColumn("_rn", F.row_number().over(same)).where(F.col("_rn") <= k).drop("_rn")
            .withColumn("ix", _axis(F.col("v_lon"), 360.0)).withColumn("iy", _axis(F.col("v_lat"), 180.0)))


def _cells(places: DataFrame, first: int, last: int) -> DataFrame:
    """(level, cell, parent, n, radius): how many places, and how far from the centre they reach."""
    rows = []
    for level in range(first, last + 1):
        lat, lon = _centre(_cell(level), level)
        rows.append(F.struct(F.lit(level).alias("level"), _cell(level).alias("cell"), _cell(level - 1).alias("parent"),
                             haversine_km(lat, lon, F.col("v_lat"), F.col("v_lon")).alias("d")))
    return (places.select(F.inline(F.array(*rows))).groupBy("level", "cell", "parent")
            .agg(F.count("*").alias("n"), F.max("d").alias("radius")))


def nearest_stations(stations: DataFrame, others: DataFrame, k: int = 3, key: str = "clave") -> DataFrame:
    """(key, orden, vecino, dist_km): the k nearest of ``others`` for each station, exactly.

    ``others`` are put into a hierarchy of cells. Going down the levels, a cell is
    dropped for a station once k places are surely closer than anything in it, so a
    station meets a handful of cells per level and the places in the last ones, not
    all places. Ties go to the lower key. Stations or others without a position have
    no distance and come last, in key order.
    """
    # Both tables are used several times; checkpoints keep whatever made the
    # stations, such as a coverage of all series, from being run again.
    known = cut_lineage(_places(others, key, k))
    places = known.where(F.col("v_lat").isNotNull())
    cells = cut_lineage(_cells(places, 1, _FIRST_LEVELS))
    # One row per level: the largest cell of each level decides how deep to go.
    summary = cells.groupBy("level").agg(F.max("n").alias("largest"), F.sum("n").alias("n")).collect()
    largest = {r["level"]: r["largest"] for r in summary}
    placed = sum(r["n"] for r in summary if r["level"] == 1)
    if largest.get(_FIRST_LEVELS, 0) > _LEAF:
        finer = cut_lineage(_cells(places, _FIRST_LEVELS + 1, _LEVELS))
        largest |= {r["level"]: r["largest"] for r in finer.groupBy("level").agg(F.max("n").alias("largest")).collect()}
        cells = cells.unionByName(finer)
    depth = next((lv for lv in range(1, _LEVELS + 1) if largest.get(lv, 0) <= _LEAF), _LEVELS)

    mine = Window.partitionBy(key)
    within = F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound"))
    targets = (stations.where(F.col("latitud").isNotNull() & F.col("longitud").isNotNull())
               .groupBy(key).agg(F.min(F.struct("latitud", "longitud")).alias("_at"))
               .select(key, "_at.latitud", "_at.longitud"))
    # Counted, and dealt in a number of its own: the levels run in one stage where their cells are broadcast, and
    # adaptive coalescing would go by the few bytes before them.
    targets = cut_lineage(targets)
    targets = targets.repartition(ceil(targets.count() / _TARGETS_PER_TASK) or 1, key)
    for level in range(1, depth + 1):
        if level == 1:   # at most 16 cells, as one array
            top = cells.where("level = 1").agg(F.collect_list(F.struct(F.col("cell").alias("child"), "n", "radius")))
            near = targets.select("*", F.lit(None).cast("double").alias("_bound"), F.inline(top.scalar()))
        else:
            below = cells.where(F.col("level") == level).select(
                F.col("cell").alias("child"), F.col("parent").alias("cell"), "n", "radius")
            near = open_cells.join(F.broadcast(below) if level <= _BOUNDED_LEVEL else below, "cell")
        lat, lon = _centre(F.col("child"), level)
        near = (near.withColumn("_mid", haversine_km(F.col("latitud"), F.col("longitud"), lat, lon))
                .withColumn("_near", F.col("_mid") - F.col("radius") - _SLACK_KM)
                .withColumn("_far", F.col("_mid") + F.col("radius") + _SLACK_KM)
                .where(within))   # by the bound of the level above, before anything is sorted
        reached = F.sum("n").over(mine.orderBy("_far", "child").rowsBetween(Window.unboundedPreceding, 0))
        bound = F.min(F.when(F.col("_reached") >= k, F.col("_far"))).over(mine)
        open_cells = (near.withColumn("_reached", reached).withColumn("_bound", F.least("_bound", bound))
                      .where(within).select(key, "latitud", "longitud", "_bound", F.col("child").alias("cell")))

    found = open_cells.join(places.withColumn("cell", _cell(depth)), "cell").withColumn(
        "dist_km", haversine_km(F.col("latitud"), F.col("longitud"), F.col("v_lat"), F.col("v_lon")))
    ranked = (found.withColumn("orden", F.row_number().over(mine.orderBy("dist_km", "vecino")))
              .where(F.col("orden") <= k).select(key, "orden", "vecino", "dist_km"))
    return ranked.unionByName(_without_distance(stations, known, k, key, placed))


def _first_keys(known: DataFrame, k: int) -> Column:
    top = known.select("vecino").orderBy("vecino").limit(k)
    return top.agg(F.sort_array(F.collect_list("vecino"))).scalar()


def _without_distance(stations: DataFrame, known: DataFrame, k: int, key: str, placed: int) -> DataFrame:
    """Neighbours that no distance decides: at most k keys, shared by all stations concerned.

    Places beyond the first k of one position are not needed here either: the lowest k
    keys of all are among the lowest k of their position.
    """
    at = F.col("latitud").isNotNull() & F.col("longitud").isNotNull()
    out = _listed(stations.where(~at), _first_keys(known, k), key, 0)
    if placed < k:
        rest = _first_keys(known.where(F.col("v_lat").isNull()), k - placed)
        out = out.unionByName(_listed(stations.where(at), rest, key, placed))
    return out


def _listed(stations: DataFrame, keys: Column, key: str, offset: int) -> DataFrame:
    return (stations.select(key).distinct().select(key, F.posexplode(keys).alias("_p", "vecino"))
            .select(key, (F.col("_p") + 1 + offset).cast("int").alias("orden"), "vecino",
                    F.lit(None).cast("double").alias("dist_km")))


def neighbour_lists(nearest: DataFrame, key: str = "clave") -> DataFrame:
    """(key, vecinos_clima): comma list in order of distance; k entries per station."""
    ranked = F.sort_array(F.collect_list(F.struct("orden", "vecino")))
    return nearest.groupBy(key).agg(F.array_join(F.transform(ranked, lambda r: r["vecino"]), ",").alias("vecinos_clima"))


def neighbour_pairs(stations: DataFrame, places: DataFrame, key: str = "clave") -> DataFrame:
    """(clave_estacion, vecino, dist_km) from comma lists; unknown neighbours drop out."""
    split = stations.where(F.col("vecinos_clima").isNotNull()).select(
        F.col(key).alias(STATION), "latitud", "longitud", F.explode(F.split("vecinos_clima", ",")).alias("vecino"))
    other = places.select(F.col(key).alias("vecino"), F.col("latitud").alias("_lat"), F.col("longitud").alias("_lon"))
    dist = haversine_km(F.col("latitud"), F.col("longitud"), F.col("_lat"), F.col("_lon"))
    return split.join(other, "vecino").select(STATION, "vecino", dist.alias("dist_km"))


def _weight(power: float) -> Column:
    return F.when(F.col("dist_km") > 0, 1 / F.pow("dist_km", F.lit(float(power)))).otherwise(1e12)


def _weighted_mean(joined: DataFrame, day: str, name: str) -> DataFrame:
    w = F.when(F.col("_v").isNotNull(), F.col("_w"))
    return joined.groupBy(STATION, day).agg(F.try_divide(F.sum(w * F.col("_v")), F.sum(w)).alias(name))


def idw_to_station(pairs: DataFrame, climate: DataFrame, value: str = "precip_mm", power: float = 2,
                   name: str = "idw", day: str = DAY) -> DataFrame:
    """(station, day, name): neighbour values weighted by 1/d^power, over the neighbours that have one.

    A day known to some neighbour without a value from any is NULL; a neighbour at
    distance zero has weight 1e12. Pairs too many to be broadcast are joined by shuffle: a neighbour shared by many stations is copied, each
    copy serving up to a thousand of them, so no task multiplies out all of its pairs.
    """
    pairs = cut_lineage(pairs)   # a few rows per station, counted and then used
    if pairs.count() <= BROADCAST_ROWS:   # sent to the readings, which are then shuffled once, as partial sums
        weighted = pairs.select(STATION, "vecino", _weight(power).alias("_w"))
        values = climate.select(F.col(STATION).alias("vecino"), F.col(day), F.col(value).alias("_v"))
        return _weighted_mean(values.join(F.broadcast(weighted), "vecino"), day, name)
    copies = pairs.groupBy("vecino").agg(F.ceil(F.count("*") / _TARGETS_PER_COPY).cast("int").alias("_copies"))
    targets = pairs.join(copies, "vecino").select(
        STATION, "vecino", _weight(power).alias("_w"), F.pmod(F.xxhash64(STATION), "_copies").cast("int").alias("_copy"))
    values = (climate.select(F.col(STATION).alias("vecino"), F.col(day), F.col(value).alias("_v"))
              .join(copies, "vecino")
              .select("vecino", day, "_v", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy")))
    return _weighted_mean(values.join(targets, ["vecino", "_copy"]), day, name)
