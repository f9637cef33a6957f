"""Elevation grids as pixel tables (basin, row, col, z); NULL or absent means no data.

Neighbourhood operators work tile by tile, each tile with a border one pixel wide, so
a basin with most of the pixels is spread over its tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, join_small
from .spatial import metric_bounds

PIXEL = ("basin", "row", "col")

# Row and column steps in the order that decides ties: up before down, left before right.
CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]
STEPS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def mosaic(tiles: DataFrame) -> DataFrame:
    """(path, basin, row, col, z) to one value per pixel: the first tile by path that has one."""
    return tiles.where(F.col("z").isNotNull()).groupBy(*PIXEL).agg(F.min_by("z", "path").alias("z"))


def mosaic_aligned(tiles: DataFrame, frames: DataFrame) -> DataFrame:
    """(basin, row, col, z) of tiles (path, basin, row, col, z) that each have their own origin and cell.

    ``frames`` (path, basin, west, north, cell) places them, north up. The result has the cell size of the
    basin's first tile by path and starts at the corner of all its tiles. A cell takes the value of the tile pixel
    that holds its centre, of the first tile by path that has one; so a source pixel goes to all cells whose centres
    it holds, to none where tiles are finer. Tiles without a frame give nothing.
    """
    target = frames.groupBy("basin").agg(F.min("west").alias("_w"), F.max("north").alias("_n"), F.min_by("cell", "path").alias("_c"))
    placed = join_small(tiles.where(F.col("z").isNotNull()), frames.join(target, "basin"), ["path", "basin"])

    def centres(start: Column, at: str) -> Column:
        """Target indexes whose centres lie in a pixel that begins at this distance from the corner."""
        first = F.ceil((start + F.col(at) * F.col("cell")) / F.col("_c") - 0.5)
        last = F.ceil((start + (F.col(at) + 1) * F.col("cell")) / F.col("_c") - 0.5) - 1
        return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))

    rows, cols = centres(F.col("_n") - F.col("north"), "row"), centres(F.col("west") - F.col("_w"), "col")
    spread = (placed.select("path", "basin", "z", rows.alias("rows"), cols.alias("cols")).withColumn("row", F.explode("rows"))
              .withColumn("col", F.explode("cols")))
    return mosaic(spread.select("path", *PIXEL, "z"))


def clip_to_boxes(pixels: DataFrame, boxes: DataFrame, west: float, north: float, cell: float) -> DataFrame:
    """Pixels of a grid in metres whose centres lie in their basin's box (basin, min_lon, min_lat, max_lon, max_lat).

    The box is projected with points along its edges, once per box, and becomes bounds in rows and columns.
    Basins without a box keep no pixel.
    """
    m = metric_bounds(boxes)
    bounds = m.select("basin", F.ceil((north - F.col("max_y")) / cell - 0.5).alias("_r0"), F.floor((north - F.col("min_y")) / cell - 0.5).alias("_r1"),
                      F.ceil((F.col("min_x") - west) / cell - 0.5).alias("_c0"), F.floor((F.col("max_x") - west) / cell - 0.5).alias("_c1"))
    kept = join_small(pixels, bounds, "basin").where(F.col("row").between(F.col("_r0"), F.col("_r1")) & F.col("col").between(F.col("_c0"), F.col("_c1")))
    return kept.select(*pixels.columns)


def clip(pixels: DataFrame, box: tuple[float, float, float, float], west: float, north: float,
         cell: float) -> DataFrame:
    """Pixels whose centre lies in (min_lon, min_lat, max_lon, max_lat) of a north-up grid.

    The box is turned into row and column bounds, so the filter reaches the scan.
    """
    min_lon, min_lat, max_lon, max_lat = box
    rows = (math.ceil((north - max_lat) / cell - 0.5), math.floor((north - min_lat) / cell - 0.5))
    cols = (math.ceil((min_lon - west) / cell - 0.5), math.floor((max_lon - west) / cell - 0.5))
    return pixels.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def resample(pixels: DataFrame, scale: float, sizes: DataFrame | None = None) -> DataFrame:
    """Grid with cells ``scale`` times as large: area mean when coarser, bilinear when finer.

    ``sizes`` (basin, height, width) are the source sizes, by default up to the last row and
    column of each basin; basins without a size keep no cell. The result has the whole cells
    that fit. Pixels without data carry no weight.
    """
    if sizes is None:
        sizes = pixels.groupBy("basin").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    whole = [F.greatest(F.lit(1), F.floor(F.col(c) / scale)).cast("int").alias(n) for c, n in (("height", "_h"), ("width", "_w"))]
    known = pixels.where(F.col("z").isNotNull())

    def shares(axis: str, size: Column) -> Column:
        """Target indexes that a source pixel contributes to, with its weight along one axis."""
        i = F.col(axis)
        if scale >= 1:
            low, high = F.floor(i / scale), F.ceil((i + 1) / scale) - 1

            def weight(t):
                return F.least((t + 1) * scale, i + 1) - F.greatest(t * scale, i)
        else:
            # Target centre t lies at (t + 0.5) * scale - 0.5 on the source axis.
            low, high = F.ceil((i - 0.5) / scale - 0.5), F.floor((i + 1.5) / scale - 0.5)

            def weight(t):
                return 1 - F.abs((t + 0.5) * scale - 0.5 - i)
        inside = F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, size - 1).cast("int"))
        listed = F.when(F.greatest(low, F.lit(0)) <= F.least(high, size - 1), inside)
        return F.filter(F.transform(listed, lambda t: F.struct(t.alias("i"), weight(t).alias("w"))),
                        lambda s: s["w"] > 0)

    sized = join_small(known, sizes.select("basin", *whole), "basin")
    parts = (sized.select("basin", "z", shares("row", F.col("_h")).alias("rs"), shares("col", F.col("_w")).alias("cs"))
             .select("basin", "z", F.explode("rs").alias("r"), "cs")
             .select("basin", "z", "r", F.explode("cs").alias("c")))
    w = F.col("r.w") * F.col("c.w")
    return (parts.groupBy("basin", F.col("r.i").alias("row"), F.col("c.i").alias("col"))
            .agg((F.sum(w * F.col("z")) / F.sum(w)).alias("z")))


TILE = 256


def bordered(pixels: DataFrame, size: int) -> DataFrame:
    """Each pixel in its own tile (``_tr``, ``_tc``), and in those next to it where it lies on the edge."""
    def sides(at: Column) -> Column:
        own, place = F.floor(at / size).cast("int"), F.pmod(at, F.lit(size))
        return F.filter(F.array(own, F.when(place == 0, own - 1), F.when(place == size - 1, own + 1)), lambda t: t.isNotNull())

    return (pixels.withColumns({"_tr": sides(F.col("row")), "_tc": sides(F.col("col"))})
            .withColumn("_tr", F.explode("_tr")).withColumn("_tc", F.explode("_tc")))


def _around(pixels: DataFrame, value: str, keys: tuple[str, ...] = (), steps=STEPS, gaps: bool = False) -> DataFrame:
    """Adds columns n0.. with the value at each step; rows are the pixels that have a value,
    with ``gaps`` also those that have none but a neighbour at every step.

    A tile gets its own pixels and a border one pixel wide from the tiles around, under two
    per cent more rows, so one exchange by tile is all; inside, neighbours are array shifts.
    Of repeated pixels the greatest value counts. A group is one tile.
    """
    size = TILE
    sent = bordered(pixels.where(F.col(value).isNotNull()).select(*keys, *PIXEL, F.col(value).cast("double").alias(value)), size)
    schema = T.StructType([*sent.drop("_tr", "_tc").schema, *[T.StructField(f"n{i}", T.DoubleType()) for i in range(len(steps))]])

    def shift(rows: pa.Table) -> pa.Table:
        top, left = (rows[t][0].as_py() * size - 1 for t in ("_tr", "_tc"))
        grid = np.full((size + 2, size + 2), np.nan)
        at = (rows["row"].to_numpy() - top, rows["col"].to_numpy() - left)
        np.fmax.at(grid, at, rows[value].to_numpy())
        there = ~np.isnan(grid)
        wanted = there[1:-1, 1:-1]
        if gaps:
            wanted = wanted | np.logical_and.reduce([there[1 + dr:size + 1 + dr, 1 + dc:size + 1 + dc] for dr, dc in steps])
        y, x = (np.argwhere(wanted) + 1).T
        around = [grid[y + dr, x + dc] for dr, dc in steps]
        first = [pa.repeat(rows[k][0], len(y)) for k in (*keys, "basin")]
        return pa.Table.from_arrays([*first, pa.array((y + top).astype(np.int32)), pa.array((x + left).astype(np.int32)), pa.array(grid[y, x], mask=~there[y, x]),
                                     *[pa.array(v, mask=np.isnan(v)) for v in around]], names=[f.name for f in schema])

    return sent.groupBy(*keys, "basin", "_tr", "_tc").applyInArrow(shift, schema)


def descent(near: DataFrame) -> DataFrame:
    """Adds ``to_row``, ``to_col`` to pixels with their neighbours n0..n7."""
    falls = []
    for i, (dr, dc) in enumerate(STEPS):
        fall = (F.col("z") - F.col(f"n{i}")) / (math.sqrt(2) if dr and dc else 1.0)
        falls.append(F.when(fall > 0, F.struct(fall.alias("fall"), F.lit(-dr).alias("up"), F.lit(-dc).alias("left"))))
    best = F.array_max(F.array_compact(F.array(*falls)))
    return near.withColumn("_b", best).withColumns({"to_row": F.col("row") - F.col("_b.up"), "to_col": F.col("col") - F.col("_b.left")}).drop("_b")


def d8_pointer(pixels: DataFrame) -> DataFrame:
    """(basin, row, col, z, to_row, to_col): steepest descent, NULL where nothing is lower.

    Diagonal steps count as the square root of two. Ties go to the upper, then the left cell.
    """
    return descent(_around(pixels.where(F.col("z").isNotNull()), "z")).select(*PIXEL, "z", "to_row", "to_col")


def _packed(row: str, col: str) -> Column:
    return F.shiftleft(F.col(row).cast("long"), 32).bitwiseOR(F.col(col).cast("long"))


def _unpacked(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("basin", F.shiftright("pix", 32).cast("int").alias("row"),
                     F.col("pix").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("col"), *keep)


class CycleError(ValueError):
    """Pointers that lead back to where they came from."""


def _rounds(state: DataFrame):
    """Counts rounds of pointer doubling while a pointer is open; paths without a cycle end in log2(nodes) + 1."""
    most, done = None, 0
    while not state().where(F.col("ptr").isNotNull()).isEmpty():
        most = math.ceil(math.log2(max(2, state().count()))) + 1 if most is None else most
        if done > most:
            raise CycleError("the pointers have a cycle between tiles")
        done += 1
        yield done


def _links(pointer: DataFrame) -> DataFrame:
    return pointer.select("basin", _packed("row", "col").alias("pix"),
                          F.when(F.col("to_row").isNotNull(), _packed("to_row", "to_col")).alias("ptr"))


# --- routes inside tiles ------------------------------------------------------------


def _tile(pix: str, size: int) -> Column:
    """Tile of a packed pixel, packed the same way."""
    col = F.col(pix).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return F.shiftleft(F.floor(F.shiftright(pix, 32) / size), 32).bitwiseOR(F.floor(col / size))


def _on_border(pix: str, size: int) -> Column:
    row, col = F.shiftright(pix, 32), F.col(pix).bitwiseAND(F.lit((1 << 32) - 1))
    return (row % size).isin(0, size - 1) | (col % size).isin(0, size - 1)


def _local_routes(pix: np.ndarray, ptr: np.ndarray, weight: np.ndarray):
    """Within one tile: what drains through each pixel and the last pixel of its path.

    ``ptr`` is -1 where the path ends. Pointer doubling on arrays; the last pixel
    points to itself.
    """
    order = np.argsort(pix)
    at = np.clip(np.searchsorted(pix, ptr, sorter=order), 0, len(pix) - 1)
    to = np.where(pix[order[at]] == ptr, order[at], np.arange(len(pix)))
    acc, last = weight, to.copy()
    for _ in range(len(pix).bit_length() + 2):   # a path of n pixels ends after log2(n) + 1 doublings
        moving = np.flatnonzero(to != np.arange(len(to)))
        if not len(moving):
            return acc, last
        gain = np.zeros_like(acc)
        np.add.at(gain, to[moving], acc[moving])
        acc = acc + gain
        last = last[last]
        # A step that ended at a last pixel has delivered; it must not deliver again.
        done = to[to] == to
        to = np.where(done, np.arange(len(to)), to[to])
    raise CycleError(f"the pointers have a cycle at pixel {int(pix[np.flatnonzero(to != np.arange(len(to)))[0]])}")


def _routes(links: DataFrame, size: int) -> DataFrame:
    """Adds to (basin, pix, ptr, ...): ``acc`` inside the tile, ``last`` pixel of the path there,
    and ``leaves``, whether the path goes on in another tile. A group is one tile."""
    tiled = links.withColumn("tile", _tile("pix", size))
    schema = T.StructType([*tiled.schema, T.StructField("acc", T.LongType()), T.StructField("last", T.LongType()),
                           T.StructField("leaves", T.BooleanType())])

    def run(rows: pa.Table) -> pa.Table:
        pix = rows["pix"].to_numpy()
        ptr = rows["ptr"].fill_null(-1).to_numpy()
        acc, last = _local_routes(pix, ptr, np.ones(len(pix), np.int64))
        return (rows.append_column("acc", pa.array(acc)).append_column("last", pa.array(pix[last]))
                .append_column("leaves", pa.array(ptr[last] != -1)))

    return tiled.groupBy("basin", "tile").applyInArrow(run, schema)


def _exits(routes: DataFrame) -> DataFrame:
    """Pixels that drain into another tile, with the pixel they drain into."""
    return (routes.where(F.col("leaves") & (F.col("pix") == F.col("last")))
            .select("basin", "pix", F.col("ptr").alias("into"), "acc"))


def _accumulate(state: DataFrame) -> DataFrame:
    """(basin, pix, acc) over a forest (basin, pix, ptr, acc).

    Pointer doubling: after round i a node holds what lies less than 2^i steps above
    it and points 2^i steps down, so the rounds grow with the logarithm of the longest
    path. Nodes whose pointer has run off send nothing and are not joined again. Each
    round ends in a checkpoint.
    """
    state = cut_lineage(state)
    for _ in _rounds(lambda: state):
        moving = state.where(F.col("ptr").isNotNull())
        sent = moving.groupBy("basin", F.col("ptr").alias("pix")).agg(F.sum("acc").alias("_add"))
        ahead = state.select("basin", F.col("pix").alias("ptr"), F.col("ptr").alias("_next"))
        jumps = moving.join(ahead, ["basin", "ptr"]).select("basin", "pix", "_next")
        state = cut_lineage(
            state.join(sent, ["basin", "pix"], "left").join(jumps, ["basin", "pix"], "left")
            .select("basin", "pix", F.col("_next").alias("ptr"),
                    (F.col("acc") + F.coalesce("_add", F.lit(0))).alias("acc")))
    return state.select("basin", "pix", "acc")


def flow_accumulation(pointer: DataFrame, tile: int = TILE) -> DataFrame:
    """(basin, row, col, acc): cells that drain through each cell, itself included.

    Tiles are solved on their own. What crosses tile borders is a forest over the
    border pixels, a few per cent of the grid, and only that forest goes through the
    rounds of pointer doubling. The inflow of each tile is then run down once more.
    """
    routes = cut_lineage(_routes(_links(pointer), tile))
    exits = _exits(routes)
    entries = routes.where(_on_border("pix", tile)).select(
        "basin", F.col("pix").alias("into"), F.when(F.col("leaves"), F.col("last")).alias("ptr"))
    totals = _accumulate(exits.join(entries, ["basin", "into"]).select("basin", "pix", "ptr", "acc"))
    inflow = (exits.drop("acc").join(totals, ["basin", "pix"]).groupBy("basin", F.col("into").alias("pix"))
              .agg(F.sum("acc").alias("extra"))
              .select(F.col("basin").alias("basin"), _tile("pix", tile).alias("tile"), F.col("pix").alias("pix"), "extra"))

    def run(rows: pa.Table, extra: pa.Table) -> pa.Table:
        pix = rows["pix"].to_numpy()
        weight = np.ones(len(pix), np.int64)
        order = np.argsort(pix)
        weight[order[np.searchsorted(pix, extra["pix"].to_numpy(), sorter=order)]] += extra["extra"].to_numpy()
        acc, _ = _local_routes(pix, rows["ptr"].fill_null(-1).to_numpy(), weight)
        return pa.table({"basin": rows["basin"], "pix": rows["pix"], "acc": pa.array(acc)})

    solved = (routes.select("basin", "tile", "pix", "ptr").groupBy("basin", "tile")
              .cogroup(inflow.groupBy("basin", "tile"))
              .applyInArrow(run, routes.select("basin", "pix", F.lit(0).cast("long").alias("acc")).schema))
    return _unpacked(solved, "acc")


def extract_streams(accumulation: DataFrame, threshold: int = 1000) -> DataFrame:
    return accumulation.where(F.col("acc") >= threshold)


def snap_points(points: DataFrame, streams: DataFrame, snap_cells: float, key: str = "clave") -> DataFrame:
    """(key, basin, row, col): nearest stream cell within a distance in cells.

    Points and streams meet on blocks as wide as the distance, so a point sees nine
    blocks. Ties go to the upper, then the left cell; points without a stream drop out.
    """
    block = max(1, math.ceil(snap_cells))
    grid = streams.select("basin", F.col("row").alias("s_row"), F.col("col").alias("s_col"),
                          F.floor(F.col("row") / block).alias("br"), F.floor(F.col("col") / block).alias("bc"))
    around = F.array(*[F.struct((F.floor(F.col("row") / block) + dr).alias("br"),
                                (F.floor(F.col("col") / block) + dc).alias("bc"))
                       for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    near = points.select(key, "basin", "row", "col", F.inline(around)).join(grid, ["basin", "br", "bc"])
    dr, dc = F.col("s_row") - F.col("row"), F.col("s_col") - F.col("col")
    dist2 = (dr * dr + dc * dc).cast("double")
    best = F.min(F.struct(dist2.alias("d"), F.col("s_row").alias("row"), F.col("s_col").alias("col")))
    return (near.where(dist2 <= snap_cells * snap_cells).groupBy(key, "basin").agg(best.alias("_b"))
            .select(key, "basin", "_b.row", "_b.col"))


def _spread(state: DataFrame) -> DataFrame:
    """(basin, pix, label) over a forest (basin, pix, ptr, label): the first label downstream.

    Labelled nodes point nowhere. A node stops being joined once it has a label or its
    path has ended.
    """
    state = cut_lineage(state)
    for _ in _rounds(lambda: state):
        ahead = state.select("basin", F.col("pix").alias("ptr"), F.col("ptr").alias("_next"), F.col("label").alias("_label"))
        moved = (state.where(F.col("ptr").isNotNull()).drop("label").join(ahead, ["basin", "ptr"])
                 .select("basin", "pix", F.col("_next").alias("ptr"), F.col("_label").alias("label")))
        state = cut_lineage(state.where(F.col("ptr").isNull()).unionByName(moved))
    return state.select("basin", "pix", "label")


def watershed(pointer: DataFrame, outlets: DataFrame, key: str = "clave", tile: int = TILE) -> DataFrame:
    """(basin, row, col, key): each cell with the first outlet downstream of it, NULL if none.

    Outlets absorb: paths end there. As with the accumulation, tiles are solved first
    and only paths between tiles are followed in rounds. Of several outlets in one cell
    the lowest key counts.
    """
    labels = outlets.groupBy("basin", _packed("row", "col").alias("pix")).agg(F.min(key).alias("label"))
    links = _links(pointer).join(labels, ["basin", "pix"], "left").select(
        "basin", "pix", F.when(F.col("label").isNull(), F.col("ptr")).alias("ptr"))
    routes = cut_lineage(_routes(links, tile).drop("acc"))
    ends = labels.withColumnRenamed("pix", "last")
    labelled = routes.where(~F.col("leaves")).join(ends, ["basin", "last"], "left").select("basin", "pix", "label")
    exits = _exits(routes.withColumn("acc", F.lit(1)))
    entries = (routes.where(_on_border("pix", tile)).join(ends, ["basin", "last"], "left")
               .select("basin", F.col("pix").alias("into"), F.when(F.col("leaves"), F.col("last")).alias("ptr"), "label"))
    # an exit into a pixel that the table does not have, as after a clip, ends there without a label
    found = _spread(exits.join(entries, ["basin", "into"], "left").select("basin", "pix", "ptr", "label"))
    onward = (routes.where(F.col("leaves")).select("basin", "pix", "last")
              .join(found.withColumnRenamed("pix", "last"), ["basin", "last"], "left").select("basin", "pix", "label"))
    return _unpacked(labelled.unionByName(onward), F.col("label").alias(key))


def with_slope(near: DataFrame, cell_size: float) -> DataFrame:
    """Adds the slope ``_s`` in degrees to pixels with neighbours n0..n3 (up, down, left, right) and the window _r0.._c1 they lie in."""
    def gradient(at: str, first: str, last: str, before: str, after: str) -> Column:
        here, b, a = F.col("z"), F.col(before), F.col(after)
        return (F.when(F.col(at) == F.col(first), a - here).when(F.col(at) == F.col(last), here - b)
                .otherwise((a - b) / 2)) / cell_size

    gy = gradient("row", "_r0", "_r1", "n0", "n1")
    gx = gradient("col", "_c0", "_c1", "n2", "n3")
    return near.withColumn("_s", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))))


def basin_attributes(labelled: DataFrame, cell_area_km2: float, key: str = "clave",
                     cell_size: float = 1.0) -> DataFrame:
    """(key, celdas, area_km2, elevacion_media, pendiente_media) of labelled pixels with z.

    The slope in degrees comes from central differences inside the basin, from one-sided
    ones on the edge of the basin's bounding box, and is missing where a neighbour
    belongs to another basin. ``cell_size`` is the spacing in units of z.
    """
    inside = labelled.where(F.col(key).isNotNull())
    near = _around(inside, "z", (key,), CROSS)
    edge = inside.groupBy(key, "basin").agg(
        F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))

    slopes = with_slope(join_small(near, edge, [key, "basin"]), cell_size)
    return slopes.groupBy(key).agg(
        F.count("*").alias("celdas"), (F.count("*") * cell_area_km2).alias("area_km2"),
        F.avg("z").alias("elevacion_media"), F.avg("_s").alias("pendiente_media"))
