"""Drainage across flat ground.

Elevations in whole metres, and filled depressions, leave wide areas of equal height where no neighbour is
lower. Two distances give such a flat a slope: how far a cell lies from the flat's outlets (cells of
the same height that have a lower neighbour), and how far from higher ground around it. Cells
drain towards outlets and away from higher ground, so that streams gather in the middle of a valley floor.

Distances are breadth-first over neighbours of equal height, tile by tile. A tile is solved with the distances
that came in over its border; what got shorter on a border goes to the tiles next to it, and only tiles
that received something are solved again. The rounds follow the number of tile borders that a
shortest way crosses, not the number of cells, and each stores border cells alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .raster import PIXEL, STEPS, TILE, _around, bordered, descent

_OUTLET = -1e12     # below every cell's own value


def spread_distances(z: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Distances over neighbours of equal ``z`` from cells with a ``start``; both have a margin of one cell of NaN and infinity."""
    width = z.shape[1]
    level, dist = z.ravel(), start.ravel().copy()
    steps = [dr * width + dc for dr, dc in STEPS]
    first = np.flatnonzero(np.isfinite(dist))
    waiting = {d: first[dist[first] == d] for d in np.unique(dist[first])}
    while waiting:
        d = min(waiting)
        front = waiting.pop(d)
        front = front[dist[front] == d]
        reached = []
        for step in steps:
            near = front + step
            near = near[(level[near] == level[front]) & (dist[near] > d + 1)]
            dist[near] = d + 1
            reached.append(near)
        found = np.unique(np.concatenate(reached))
        if len(found):
            waiting[d + 1] = np.concatenate([waiting[d + 1], found]) if d + 1 in waiting else found
    return dist.reshape(z.shape)


def _solver(tile: int, edge_only: bool):
    """Distances of one tile's cells (basin, row, col, z, seed, _tr, _tc), given those that came in (..., row, col, dist)."""
    def run(cells: pa.Table, came: pa.Table) -> pa.Table:
        if not len(cells):
            return empty
        top, left = (cells[t][0].as_py() * tile - 1 for t in ("_tr", "_tc"))
        z, start = np.full((tile + 2, tile + 2), np.nan), np.full((tile + 2, tile + 2), np.inf)
        r, c = cells["row"].to_numpy() - top, cells["col"].to_numpy() - left
        z[r, c] = cells["z"].to_numpy()
        start[r, c] = np.where(cells["seed"].to_numpy(zero_copy_only=False), 0, np.inf)
        np.minimum.at(start, (came["row"].to_numpy() - top, came["col"].to_numpy() - left), came["dist"].to_numpy())
        dist = spread_distances(z, start)[r, c]
        keep = np.isfinite(dist)
        if edge_only:
            keep &= (r == 1) | (r == tile) | (c == 1) | (c == tile)
        found = cells.filter(pa.array(keep)).select(names[:-1])
        return found.append_column("dist", pa.array(dist[keep].astype(np.int64))).cast(empty.schema)

    names = ["basin", "row", "col", "z", "dist"]
    empty = pa.schema([("basin", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("z", pa.float64()), ("dist", pa.int64())]).empty_table()
    return run


_FOUND = "basin string, row int, col int, z double, dist long"


def flat_distances(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(basin, row, col, z, dist): steps from the nearest seed over neighbours of equal height.

    ``cells`` (basin, row, col, z, seed) must not repeat a pixel; cells that no seed reaches are left out.
    """
    where = ("basin", "_tr", "_tc")
    tiled = cells.withColumns({"_tr": F.floor(F.col("row") / tile).cast("int"), "_tc": F.floor(F.col("col") / tile).cast("int")})
    ring = F.pmod("row", F.lit(tile)).isin(0, tile - 1) | F.pmod("col", F.lit(tile)).isin(0, tile - 1)
    edge = stored(tiled.where(ring).select(*where, "row", "col", "z"), "flat-edges")
    around = F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in STEPS])
    own_row, own_col = F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)
    nothing = cells.sparkSession.createDataFrame([], "basin string, _tr int, _tc int, row int, col int, dist long")
    found, came = nothing.drop("_tr", "_tc"), nothing    # distances on borders, solved and received
    busy = tiled.where("seed").select(*where).distinct()
    while True:
        solved = stored((tiled.join(busy, list(where), "left_semi").groupBy(*where).cogroup(came.groupBy(*where))
                         .applyInArrow(_solver(tile, edge_only=True), _FOUND)), "flat-solved")
        found = found.unionByName(solved.select(*PIXEL, "dist"))
        sent = (solved.withColumns({"_or": own_row, "_oc": own_col}).select("basin", "z", "dist", "_or", "_oc", F.inline(around))
                .where((own_row != F.col("_or")) | (own_col != F.col("_oc")))
                .groupBy("basin", "row", "col", "z").agg((F.min("dist") + 1).alias("dist")))
        best = found.groupBy(*PIXEL).agg(F.min("dist").alias("best"))
        shorter = stored(sent.join(edge, ["basin", "row", "col", "z"]).join(best, list(PIXEL), "left")
                         .where(F.col("best").isNull() | (F.col("dist") < F.col("best"))).select(*where, "row", "col", "dist"), "flat-shorter")
        if shorter.isEmpty():
            break
        came = came.unionByName(shorter)      # a solver takes the least of several
        busy = shorter.select(*where).distinct()
    return tiled.groupBy(*where).cogroup(came.groupBy(*where)).applyInArrow(_solver(tile, edge_only=False), _FOUND)


def _downhill(sloped: DataFrame, tile: int) -> DataFrame:
    """(basin, row, col, to_row, to_col) of cells (basin, row, col, z, slope): the neighbour of equal height with the least slope value."""
    def run(rows: pa.Table) -> pa.Table:
        top, left = (rows[t][0].as_py() * tile - 1 for t in ("_tr", "_tc"))
        z, slope = np.full((tile + 2, tile + 2), np.nan), np.full((tile + 2, tile + 2), np.inf)
        at = (rows["row"].to_numpy() - top, rows["col"].to_numpy() - left)
        z[at], slope[at] = rows["z"].to_numpy(), rows["slope"].to_numpy()
        y, x = (np.argwhere(np.isfinite(slope[1:-1, 1:-1]) & (slope[1:-1, 1:-1] > _OUTLET)) + 1).T
        around = np.array([np.where(z[y + dr, x + dc] == z[y, x], slope[y + dr, x + dc], np.inf) for dr, dc in STEPS])
        pick = around.argmin(axis=0) if len(y) else np.empty(0, np.int64)   # the first of equal ones: upper, then left
        step = np.array(STEPS)[pick]
        return pa.table({"basin": pa.repeat(rows["basin"][0], len(y)), "row": pa.array((y + top).astype(np.int32)), "col": pa.array((x + left).astype(np.int32)),
                         "to_row": pa.array((y + top + step[:, 0]).astype(np.int32)), "to_col": pa.array((x + left + step[:, 1]).astype(np.int32))})

    return bordered(sloped, tile).groupBy("basin", "_tr", "_tc").applyInArrow(run, "basin string, row int, col int, to_row int, to_col int")


def d8_flats(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(basin, row, col, z, to_row, to_col): steepest descent, and across flats the way to their outlets.

    A flat cell points at the neighbour of equal height with the least 2 * (steps to an outlet) - (steps from higher
    ground), outlets first; ties go to the upper, then the left cell. Each such step lowers that value, so there are no
    cycles. Flats without an outlet, as at the bottom of a depression, keep NULL, as do lone cells that nothing lies below.
    Pixels without data take no part; of repeated pixels the greatest value counts. Elevations are compared exactly.
    """
    near = _around(pixels.where(F.col("z").isNotNull()).withColumn("basin", F.col("basin").cast("string")), "z")
    some = [F.col(f"n{i}") for i in range(len(STEPS))]
    level = F.greatest(*[F.coalesce((n == F.col("z")).cast("int"), F.lit(0)) for n in some]) == 1
    higher = F.greatest(*[F.coalesce((n > F.col("z")).cast("int"), F.lit(0)) for n in some]) == 1
    ground = stored(descent(near).select(*PIXEL, "z", "to_row", "to_col", level.alias("level"), higher.alias("higher")), "ground")
    flat = ground.where("level")
    still = flat.where("to_row IS NULL")
    low = flat_distances(flat.select(*PIXEL, "z", F.col("to_row").isNotNull().alias("seed")), tile)
    high = flat_distances(still.select(*PIXEL, "z", F.col("higher").alias("seed")), tile)
    away = high.select(*PIXEL, (F.col("dist") + 1).alias("away"))
    slope = F.when(F.col("dist") == 0, F.lit(_OUTLET)).otherwise((2 * F.col("dist") - F.coalesce("away", F.lit(0))).cast("double"))
    sloped = low.join(away, list(PIXEL), "left").select(*PIXEL, "z", slope.alias("slope"))
    found = _downhill(sloped, tile).withColumnsRenamed({"to_row": "_r", "to_col": "_c"})
    return ground.join(found, list(PIXEL), "left").select(
        *PIXEL, "z", F.coalesce("to_row", "_r").alias("to_row"), F.coalesce("to_col", "_c").alias("to_col"))
