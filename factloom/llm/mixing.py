"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Each (source, size) class is ranked in so many parts, so that no class of equal sizes has to be sorted in one task.
PARTS = 1024
WEIGHTS = (5.0, 2.0, 1.0)
_CLASS = ["__source", "__size", "__part"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Target of each source from its (source, source_size): ``share`` of all sizes by weight, none above ``most``
    times its size, the excess given again by weight. Sources are in code point order, null last, and take the
    weights in turn. Sources without words get 0.

    Handing the excess on until none is above ends at one level t with target = least(cap, weight * t). Sources are
    full in order of cap / weight, and t is what is left over the weights left at the first that isn't: the largest
    such quotient of those that hold. One row a source is sorted here, nothing else.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    caps = (
        caps.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    level = (F.col("total") - F.col("full_before")) / F.col("weight_left")
    caps = caps.withColumn("level", F.when(F.col("cap") / F.col("weight") >= level, level)).withColumn("level", F.max("level").over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return caps.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 0, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with columns __size, __source_size, __target and __copies (how often the mix takes the row).

    Each row of a source expects target / source_size copies. Rows are ranked by (size, part, id) within the source,
    which spreads every size evenly over the sample; a row gets one copy for each integer between its two prefix sums
    plus one offset drawn for the source. Ranks come from counts of (source, size, part) classes, summed up in a table
    of classes, and a row number within the class, so a source of any size is ranked in parallel.

    Null sources are one source, a null text has size 0, equal rows share their copies in any order, an empty table
    gives an empty result; other columns pass through; ids may be
    of any type. Reruns agree, as nothing depends on partitions.
    """
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    part = F.coalesce(F.pmod(number, F.lit(PARTS)), F.lit(-1).cast("long"))
    rows = docs.withColumns({"__source": F.col(source_col), "__size": size_of(F.col(text_col)), "__part": part})
    narrow = docs.select(F.col(source_col).alias("__source"), size_of(F.col(text_col)).alias("__size"), part.alias("__part"))
    classes = narrow.groupBy(*_CLASS).agg(F.count(F.lit(1)).alias("n"))
    by_size = classes.groupBy("__source", "__size").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("__source").orderBy("__size").rowsBetween(Window.unboundedPreceding, -1)
    size_start = by_size.select(F.col("__source").alias("s"), F.col("__size").alias("z"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("size_start"))
    in_size = Window.partitionBy("__source", "__size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.withColumn("part_start", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    starts = starts.join(size_start, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__size") == F.col("z")))
    goal = targets(by_size.groupBy(F.col("__source").alias("source")).agg(F.sum(F.col("__size") * F.col("n")).alias("source_size")), share, most, weights)
    goal = goal.withColumnsRenamed({"source": "gs", "source_size": "__source_size", "target": "__target"})
    starts = starts.join(goal, F.col("__source").eqNullSafe(F.col("gs"))).select(
        F.col("__source").alias("ks"), F.col("__size").alias("kz"), F.col("__part").alias("kp"), (F.col("size_start") + F.col("part_start")).alias("__start"), "__source_size", "__target")
    rows = rows.withColumn("__row", F.row_number().over(Window.partitionBy(*_CLASS).orderBy(id_col)) - 1)
    rows = rows.join(starts, F.col("__source").eqNullSafe(F.col("ks")) & (F.col("__size") == F.col("kz")) & (F.col("__part") == F.col("kp")))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("__source"), F.lit("")), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rank = F.col("__start") + F.col("__row")
    copies = (F.floor(offset + rate * (rank + 1)) - F.floor(offset + rate * rank)).cast("long")
    return rows.withColumn("__copies", copies).drop("__source", "__part", "__row", "__start", "ks", "kz", "kp")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, seed).where(F.col("__copies") > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
