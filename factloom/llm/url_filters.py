"""URL filter lists over time: dated entries become validity intervals, captures join those active when fetched.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where ``url`` is null or has none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$|\.+$", "")), F.lit(""))


def keys_of(url: Column) -> Column:
    """Keys a list entry may name: the host, its parent domains of two labels or more, and host/first path segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*(/[^/?#]+)", 1)
    keys = F.concat(F.array(host), parents, F.when(segment != "", F.array(F.concat(host, segment))).otherwise(F.array().cast("array<string>")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def intervals(entries: DataFrame) -> DataFrame:
    """[valid_from, valid_to) of each listing from (list_name, key, action, entry_date), valid_to null while it lasts.

    An 'add' lists the key until its next entry; of entries of one day the 'remove' holds over the 'add', repeated
    entries count once; rows with a null are no entries.
    """
    days = entries.dropna(subset=["list_name", "key", "action", "entry_date"]).groupBy("list_name", "key", "entry_date").agg(F.max(F.col("action") == "remove").alias("removed"))
    later = F.lead("entry_date").over(Window.partitionBy("list_name", "key").orderBy("entry_date"))
    return days.withColumn("valid_to", later).where(~F.col("removed")).select("list_name", "key", F.col("entry_date").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", date_col: str = "fetched") -> DataFrame:
    """``captures``' (id, url, fetched) with ``lists`` (names active for it, sorted, joined by ',') and ``blocked``.

    Captures of one key and day are looked up once, so a host with most of the rows meets the intervals as a few rows,
    and the verdicts join back on (key, day). A null url or date matches nothing; repeated rows are each evaluated.
    """
    rows = captures.select(F.col(id_col), F.col(url_col), F.col(date_col)).withColumn("__row", F.struct(id_col, url_col, date_col))
    wide = rows.select("__row", F.col(date_col).alias("day"), F.explode(keys_of(F.col(url_col))).alias("key")).distinct()
    asked = wide.select("key", "day").distinct()
    active = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    verdicts = asked.join(listed, "key").where(active).groupBy("key", "day").agg(F.collect_set("list_name").alias("names"))
    hits = wide.join(verdicts, ["key", "day"]).groupBy("__row").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ",").alias("lists"))
    hits = hits.select(F.col("__row").alias("__hit"), "lists")
    joined = rows.join(hits, F.col("__row").eqNullSafe(F.col("__hit")), "left")
    return joined.select(id_col, url_col, date_col, F.coalesce("lists", F.lit("")).alias("lists"), F.col("lists").isNotNull().alias("blocked"))
