"""Exact quantiles of large groups.

``percentile`` keeps a group's distinct values in one task. That is right for a
station with one value per day and wrong for a region or a whole table. Here one pass
counts values per bucket and the buckets that hold the wanted ranks are found from the
counts. A bucket with many rows, as data far from zero have, is cut again between its own
least and greatest value, pass by pass, until it is small or holds one value only; the
last pass puts what is left in order. As long as the groups are few enough to send the
wanted buckets to the rows, no pass shuffles the other values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut_lineage

_STEPS = 2048.0          # buckets per factor e: values in one bucket differ by 0.05 %
_PARTS = 4096            # parts of a bucket that is cut again
_SMALL = 100_000         # rows that one task may put in order
_SHIFT = 1 << 21         # above 745 * 2048, the largest |ln| of a double in steps


def _bucket(v: Column) -> Column:
    """Monotone in v, and bounded: some ten thousand buckets per group in practice."""
    size = F.floor(F.ln(F.abs(v)) * _STEPS) + _SHIFT
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., prob, quantile) with linear interpolation between ranks; NULL groups are dropped."""
    by = list(by)
    v = F.col(value).cast("double")
    base = df.select(*by, v.alias("_v"), _bucket(v).alias("_b")).where(F.col("_v").isNotNull())
    for c in by:
        base = base.where(F.col(c).isNotNull())

    hist = base.groupBy(*by, "_b").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    run = Window.partitionBy(*by).orderBy("_b")
    hist = (hist.withColumn("_end", F.sum("_n").over(run))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy(*by))))
    wanted = []
    for p in probs:
        pos = (F.col("_total") - 1) * F.lit(p)
        wanted += [F.struct(F.lit(p).alias("prob"), F.lit(side).alias("side"), rank.cast("long").alias("rank"),
                            (pos - F.floor(pos)).alias("frac"))
                   for side, rank in ((0, F.floor(pos)), (1, F.ceil(pos)))]
    # At most two rows per group and quantile.
    picks = _picked(hist.withColumn("_ranks", F.array(*wanted)), by)
    while not picks.where((F.col("_n") > _SMALL) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        rows = _inside(base, picks.drop("_n"), by)
        part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _PARTS)
        cut = (rows.withColumn("_part", F.when(F.col("_hi") > F.col("_lo"), F.least(part, F.lit(_PARTS - 1))).otherwise(F.lit(0)))
               .groupBy(*by, "_b", F.col("_lo").alias("_from"), "_part")
               .agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.any_value("_before").alias("_before"),
                    F.any_value("_ranks").alias("_ranks")))
        within = Window.partitionBy(*by, "_b", "_from").orderBy("_part")
        picks = _picked(cut.withColumn("_end", F.col("_before") + F.sum("_n").over(within)), by)
    # Equal values collapse before the shuffle, and the shuffle key holds the value, so
    # neither a hot group nor a hot value lands in one task.
    counts = _inside(base, picks.select(*by, "_b", "_lo", "_hi"), by).groupBy(*by, "_b", "_lo", "_v").agg(F.count("*").alias("_n"))
    inside = counts.join(_side(picks.drop("_n", "_hi")), [*by, "_b", "_lo"])
    order = Window.partitionBy(*by, "_b", "_lo").orderBy("_v")
    inside = inside.withColumn("_end", F.col("_before") + F.sum("_n").over(order))
    sides = inside.select(*by, "_v", F.explode(_here()).alias("r"))
    low = F.max(F.when(F.col("r.side") == 0, F.col("_v")))
    high = F.max(F.when(F.col("r.side") == 1, F.col("_v")))
    return (sides.groupBy(*by, F.col("r.prob").alias("prob"))
            .agg((low + (high - low) * F.max("r.frac")).alias("quantile")))


def _here() -> Column:
    """The wanted ranks among the ``_n`` rows that end at ``_end``."""
    return F.filter("_ranks", lambda r: (r["rank"] >= F.col("_end") - F.col("_n")) & (r["rank"] < F.col("_end")))


def _picked(hist: DataFrame, by: list[str]) -> DataFrame:
    """Buckets with a wanted rank: their bounds, the rows before them, and their ranks."""
    return cut_lineage(hist.select(*by, "_b", "_lo", "_hi", "_n", (F.col("_end") - F.col("_n")).alias("_before"), _here().alias("_ranks"))
                       .where(F.size("_ranks") > 0))


def _side(picks: DataFrame) -> DataFrame:
    """While they are few, as with regions or seasons, the picks go to the rows."""
    return F.broadcast(picks) if picks.count() <= BROADCAST_ROWS else picks


def _inside(base: DataFrame, picks: DataFrame, by: list[str]) -> DataFrame:
    return base.join(_side(picks), [*by, "_b"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def quantile_columns(df: DataFrame, value: str, probs: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """The same, one column per name."""
    long = exact_quantiles(df, value, list(probs.values()), by)
    cols = [F.max(F.when(F.col("prob") == F.lit(p), F.col("quantile"))).alias(n) for n, p in probs.items()]
    return long.groupBy(*by).agg(*cols)
