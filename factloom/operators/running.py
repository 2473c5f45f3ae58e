"""Running sums over all rows in order, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def with_sum_before(rows: DataFrame, value: str, order: str, group: str | None = None, name: str = "sum_before", n: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` (null counts 0) in all rows before them, in the order of ``order`` (nulls
    first), within each ``group`` if one is given (null is a group). Rows that tie in it are ordered by a hash of
    their columns, so that ties too are spread over ranges.

    Rows are dealt over ``n`` ranges of (group, order, hash). A range sums its part of each group; what precedes it in
    the group is the sum of the group's parts in ranges before, which only groups that reach over several ranges need,
    so no more rows than ranges are sent to all tasks; within ranges the sum runs as usual."""
    n = n or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [group] if group else []
    amount = F.coalesce(F.col(value), F.lit(0))
    dealt = rows.withColumn("__hash", F.xxhash64(*rows.columns)).repartitionByRange(n, *keys, order, "__hash").withColumn("__range", F.spark_partition_id())
    dealt = kept(dealt)
    parts = dealt.groupBy(*keys, "__range").agg(F.sum(amount).alias("__part"))
    ahead = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and group
    offsets = parts.withColumn("__offset", F.sum("__part").over(ahead)).where("__offset is not null").drop("__part")
    offsets = offsets.withColumnsRenamed({k: f"__{k}" for k in keys} | {"__range": "__r"})
    met = F.col("__range") == F.col("__r")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = Window.partitionBy("__range", *keys).orderBy(order, "__hash").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("__within", F.sum(amount).over(within)).join(F.broadcast(offsets), met, "left")
    zero = F.lit(0).cast(parts.schema["__part"].dataType)
    return out.withColumn(name, F.coalesce("__within", zero) + F.coalesce("__offset", zero)).select(*rows.columns, name)
