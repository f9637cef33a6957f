"""Filling short gaps inside a station's series.

Positions, not dates, are the abscissa; call ``to_daily`` first to make them agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DAY, MAX_GAP, QUALITY, STATION
from ..functions.numeric import ordered
from ..functions.spline import cubic_at


def _gap_frame(df: DataFrame, value: str, group: str, day: str) -> DataFrame:
    """Adds row position and the position and value of the valid neighbours.

    The look ahead runs over the descending order: a frame that ends at the last row
    would be evaluated afresh for every row.
    """
    back, ahead = ordered(group, day), Window.partitionBy(group).orderBy(F.col(day).desc())
    v = F.col(value)
    known = F.when(v.isNotNull(), F.struct(F.col("_pos").alias("p"), v.alias("v")))
    return (df.withColumn("_pos", F.row_number().over(back))
            .withColumn("_prev", F.last(known, ignorenulls=True).over(back))
            .withColumn("_next", F.last(known, ignorenulls=True).over(ahead)))


def _fillable(value: str, max_gap: int, mode: str):
    inside = F.col(value).isNull() & F.col("_prev").isNotNull() & F.col("_next").isNotNull()
    if mode == "whole":
        return inside & (F.col("_next.p") - F.col("_prev.p") - 1 <= max_gap)
    return inside & (F.col("_pos") - F.col("_prev.p") <= max_gap)


def impute_short_gaps(df: DataFrame, value_col: str, group: str = STATION, max_gap: int = MAX_GAP,
                      method: str = "cubic", mode: str = "prefix", day: str = DAY) -> DataFrame:
    """Fill at most ``max_gap`` missing rows after a valid one, never outside the valid range.

    ``mode="prefix"`` also fills the first rows of longer gaps, ``mode="whole"`` only
    gaps that close within the limit. Filled rows get a quality flag of at least 1.
    ``method="cubic"`` puts one spline through all valid rows of a station and falls
    back to straight lines below four of them.
    """
    if QUALITY not in df.columns:
        df = df.withColumn(QUALITY, F.lit(0))
    columns = df.columns
    framed = _gap_frame(df, value_col, group, day).withColumn("_fill", _fillable(value_col, max_gap, mode))
    slope = (F.col("_next.v") - F.col("_prev.v")) / (F.col("_next.p") - F.col("_prev.p"))
    line = F.col("_prev.v") + slope * (F.col("_pos") - F.col("_prev.p"))
    # clip(lower=1) keeps a missing flag missing; greatest would turn it into 1.
    flag = F.when(F.col("_fill") & F.col(QUALITY).isNotNull(), F.greatest(F.col(QUALITY), F.lit(1))
                  ).otherwise(F.col(QUALITY))
    filled = F.when(F.col("_fill"), line).otherwise(F.col(value_col))
    framed = framed.withColumn("_line", filled).withColumn("_flag", flag)

    def finish(frame: DataFrame, value: str) -> DataFrame:
        return frame.select(*[F.col(value).alias(c) if c == value_col
                              else F.col("_flag").alias(c) if c == QUALITY
                              else F.col(c) for c in columns])

    if method == "linear":
        return finish(framed, "_line")
    if method != "cubic":
        raise ValueError(f"unknown method {method!r}")

    # One pass: stations are cut out of batches that hold many of them, in the partitioning
    # that the windows have made; the values of a station stand together and in order.
    # The sort costs nothing where the windows' own order is in place; it states what is relied on.
    rows = framed.drop("_prev", "_next").sortWithinPartitions(group)
    at = rows.columns.index("_line")

    def splines(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = pc.fill_null(batch.column(group).cast(pa.string()), "")
            # all but the last station are complete; a null key counts as one station
            last = pc.index(pc.equal(keys, keys[-1]), True).as_py() if len(keys) else 0
            if held and len(keys) and pc.fill_null(held[-1].column(group).cast(pa.string()), "")[-1].as_py() == keys[-1].as_py() and last == 0:
                held.append(batch)
                continue
            done = pa.Table.from_batches([*held, batch.slice(0, last)])
            if len(done):
                yield from _curved(done, group, value_col, at).to_batches()
            held = [batch.slice(last)]
        if held:
            yield from _curved(pa.Table.from_batches(held), group, value_col, at).to_batches()

    return finish(rows.mapInArrow(splines, rows.schema), "_line")


def _curved(rows: pa.Table, group: str, value_col: str, at: int) -> pa.Table:
    """Whole stations with the filled values of those that have at least four known ones on their spline."""
    keys = pc.fill_null(rows[group].cast(pa.string()), "").to_numpy(zero_copy_only=False)
    pos = rows["_pos"].to_numpy().astype(float)
    y = rows[value_col].to_numpy().astype(float)
    line = rows["_line"].to_numpy().astype(float)
    fill = rows["_fill"].fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
        mine, known = np.flatnonzero(fill[a:b]) + a, np.flatnonzero(~np.isnan(y[a:b])) + a
        known = known[np.argsort(pos[known])]
        if len(mine) and len(known) >= 4:
            line[mine] = cubic_at(pos[known], y[known], pos[mine])
    return rows.set_column(at, "_line", pa.array(line, mask=np.isnan(line)))
