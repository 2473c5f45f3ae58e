"""Days and the intervals that hold them, joined by nested bins of time.

An interval is cut into at most two bins of each size, the sizes being powers of two days; a day is in one bin of each
size. A bin holds a day just once, so the two meet on equal (size, bin), and no interval is compared with a day that it
doesn't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sizes(days: DataFrame, day: str) -> tuple[Column, int] | None:
    """The first day, as a literal, and how many doublings reach the last; None without days."""
    first, last = days.agg(F.min(day), F.max(day)).head()
    return None if first is None else (F.lit(first), (last - first).days.bit_length())


def pieces(first: Column, levels: int, start: Column, end: Column) -> Column:
    """The bins {size, bin} that make up the days from ``start`` to ``end`` (both held, nulls open), counted from
    ``first`` and cut to the 2^levels days from there."""
    low = F.greatest(F.coalesce(F.datediff(start, first), F.lit(0)), F.lit(0))
    high = F.least(F.coalesce(F.datediff(end, first), F.lit(1 << levels)) + 1, F.lit(1 << levels))
    out = []
    for size in range(levels + 1):
        a, b = F.shiftright(low + ((1 << size) - 1), size), F.shiftright(high, size)
        bin_ = lambda x: F.struct(F.lit(size).alias("size"), x.cast("int").alias("bin"))  # noqa: B023, E731
        out += [F.when((a < b) & (a % 2 == 1), bin_(a)), F.when((a < b) & (b % 2 == 1), bin_(b - 1))]
    return F.array_compact(F.array(*out))


def _binned(days: DataFrame, day: str, first: Column, levels: int) -> DataFrame:
    at = F.datediff(F.col(day), first)
    return days.withColumn("__b", F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.shiftright(at, s).cast("int").alias("bin")) for s in range(levels + 1)))))


def holding(rows: DataFrame, days: DataFrame, start: str = "valid_from", end: str = "valid_to", day: str = "day") -> DataFrame:
    """Each of ``rows`` with each of ``days`` (day, other columns) that its interval holds; null ends are open. Null
    days are in none."""
    found = _sizes(days, day)
    if found is None:
        return rows.join(days, F.lit(False))
    cut = rows.withColumn("__p", F.explode(pieces(*found, F.col(start), F.col(end))))
    return cut.join(_binned(days.where(F.col(day).isNotNull()), day, *found), F.col("__p") == F.col("__b")).drop("__p", "__b")


def counts(rows: DataFrame, days: DataFrame, by: list[str], start: str = "valid_from", end: str = "valid_to", day: str = "day") -> DataFrame:
    """(day, by, n): how many of ``rows`` each day holds, where any does; rows are counted by bin before days meet them,
    so the work is that of the rows and of the days, not of their pairs."""
    found = _sizes(days, day)
    if found is None:
        return rows.select(*by).join(days.select(day), F.lit(False)).groupBy(day, *by).agg(F.count(F.lit(1)).alias("n"))
    bins = rows.select(*by, F.explode(pieces(*found, F.col(start), F.col(end))).alias("__p")).groupBy("__p", *by).agg(F.count(F.lit(1)).alias("__n"))
    met = bins.join(_binned(days.where(F.col(day).isNotNull()).select(day).distinct(), day, *found), F.col("__p") == F.col("__b"))
    return met.groupBy(day, *by).agg(F.sum("__n").alias("n"))
