"""Ranks and running sums over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that running sums are split into.
RANGES = 128
_NUMBERS = ("byte", "tinyint", "short", "smallint", "int", "bigint", "float", "double")


def _ranges(df: DataFrame, column: str) -> Column | None:
    """The range of a number, 0 to RANGES, by approximate quantiles; None for other types."""
    if df.schema[column].dataType.simpleString() not in _NUMBERS:
        return None
    bounds = sorted(set(df.select(F.col(column).cast("double").alias("x")).approxQuantile("x", [i / RANGES for i in range(1, RANGES)], 0.002)))
    if not bounds:
        return None
    return F.size(F.filter(F.lit(bounds), lambda b: b < F.col(column).cast("double")))


def running(df: DataFrame, by: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """df with out = the sum of column over all rows up to and with this one in the order of `by`, for out: column in sums.

    Rows of a range of values are summed in a task of their own; only the ranges' sums, at most RANGES + 1, meet in one.
    """
    order = F.desc(by) if descending else F.asc(by)
    where = _ranges(df, by)
    if where is None:
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(c).over(w) for out, c in sums.items()})
    cut = df.withColumn("__range", where)
    before = Window.orderBy(F.desc("__range") if descending else F.asc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__range").agg(*(F.sum(c).alias(f"__{out}") for out, c in sums.items()))
    starts = starts.select("__range", *(F.coalesce(F.sum(f"__{out}").over(before), F.lit(0)).alias(f"__{out}") for out in sums))
    w = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumns({out: F.sum(c).over(w) for out, c in sums.items()}).join(F.broadcast(starts), "__range")
    return own.withColumns({out: F.col(out) + F.col(f"__{out}") for out in sums}).drop("__range", *(f"__{out}" for out in sums))


def ranked(df: DataFrame, groups: list[tuple[str, Column]], order: list[Column], out: str = "rank") -> DataFrame:
    """df with `out`, the rows' numbers from 1 in the order of the groups and, within a group, of `order`.

    groups: (name, what is sorted by) of columns that come first in the order. Rows are numbered within their groups in
    parallel; a single numeric group's counts are summed by ranges, other groups' counts, far fewer than rows, in one
    window.
    """
    names = [n for n, _ in groups]
    counts = df.groupBy(*names).agg(F.count("*").alias("__n"))
    if len(groups) == 1 and counts.schema[names[0]].dataType.simpleString() in _NUMBERS:
        starts = running(counts, names[0], {"__upto": "__n"}).select(names[0], (F.col("__upto") - F.col("__n")).alias("__from"))
    else:
        before = Window.orderBy(*(c for _, c in groups)).rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = df.withColumn("__local", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    return numbered.join(starts, names).withColumn(out, (F.col("__from") + F.col("__local")).cast("long")).drop("__from", "__local")
