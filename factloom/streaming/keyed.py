"""Conflicts and ends of facts kept as state of each (subject, predicate), so that a batch reads nothing of the store.

Facts whose id was there are dropped by Spark's state of ids. The state of a key is the list of its facts, each with the
time of the batch that brought it, an aggregate that Spark reads and writes once a batch for each key that the batch
touches. What a batch changes is told from the list with and without the batch's own facts: members of conflicts, all of
them once a second value is there and new ones from then on, and ends, also those that a late fact moves or takes back.
Facts of one day get the same successor, and only the last of them ends. ``current_conflicts`` and ``with_current_ends``
make of the changes what batch detection and supersession make of all facts, whatever the order of their arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import facts as ops

CHANGES = "kind string, subject_id string, predicate string, fact_id string, valid_to date"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _differ(facts: Column) -> Column:
    values = F.transform(facts, lambda x: x.value)
    return F.coalesce(F.array_min(values) < F.array_max(values), F.lit(False))


def _ended(facts: Column) -> Column:
    """(id, came, until) of sorted ``facts``: the last of a day ends the day before the next one, if no end was given."""
    def end(x: Column, i: Column) -> Column:
        follows = F.get(facts, i + 1).day
        return F.struct(x.id.alias("id"), x.came.alias("came"), F.when(~x.given & (follows > x.day), F.date_sub(follows, 1)).alias("until"))

    return F.transform(facts, end)


def _told(ends: Column) -> Column:
    """As strings, of which Spark subtracts arrays by hashes."""
    return F.transform(ends, lambda e: F.concat(F.coalesce(e.until.cast("string"), F.lit("")), F.lit("|"), e.id))


def changes(stream: DataFrame, predicates: DataFrame) -> DataFrame:
    """The stream of changes (kind, subject_id, predicate, fact_id, valid_to) that facts (id, seq, subject_id, predicate,
    canonical_value, valid_from, valid_to) bring. A fact whose id was there changes nothing; predicates that allow
    several values have neither conflicts nor ends, so nothing is kept of them."""
    now = F.unix_millis(F.current_timestamp())  # the batch's own time, the same when it runs again
    rows = ops.with_contract(stream, predicates).where("not allow_multi")
    rows = rows.select(*ops.GROUP, F.when(F.col("time_varying"), F.col("valid_from")).alias("day"), "seq", "id", F.col("valid_to").isNotNull().alias("given"), F.col("canonical_value").alias("value"))
    rows = rows.dropDuplicates([*ops.GROUP, "id"]).withColumn("came", now)
    keys = rows.groupBy(*ops.GROUP).agg(F.sort_array(F.collect_list(F.struct("day", "seq", "id", "given", "value", "came"))).alias("facts"))
    keys = keys.withColumn("old", F.filter("facts", lambda x: x.came != now))
    facts, old = F.col("facts"), F.col("old")
    members = F.when(_differ(old), F.filter(facts, lambda x: x.came == now)).when(_differ(facts), facts).otherwise(F.slice(facts, 1, 0))
    # a new fact without an end has nothing to tell
    ends = F.array_except(_told(F.filter(_ended(facts), lambda e: e.until.isNotNull() | (e.came != now))), _told(_ended(old)))
    change = lambda kind, fact, end: F.struct(F.lit(kind).alias("kind"), fact.alias("fact_id"), end.cast("date").alias("valid_to"))
    sent = F.concat(
        F.transform(members, lambda x: change("member", x.id, F.lit(None))),
        F.transform(ends, lambda x: change("end", F.substr(x, F.locate("|", x) + 1), F.nullif(F.substring_index(x, "|", 1), F.lit("")))))
    return keys.select(*ops.GROUP, F.inline(sent)).select("kind", *ops.GROUP, "fact_id", "valid_to")


def detect_with_state(stream: DataFrame, predicates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes the changes of each batch to its own folder of ``path`` and ends with what is there. A
    batch that runs again replaces its folder, so a restart from ``checkpoint`` goes on as if there had been none."""
    conf = stream.sparkSession.conf
    if "RocksDB" not in conf.get(_PROVIDER):
        conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return changes(stream, predicates).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark, path: str) -> DataFrame:
    return spark.read.schema(CHANGES + ", batch int").parquet(path)


def current_conflicts(changed: DataFrame) -> DataFrame:
    """Open conflicts with their sorted members, as ``detect_conflicts`` has them of all facts."""
    groups = changed.where("kind = 'member'").groupBy(*ops.GROUP).agg(F.array_sort(F.collect_set("fact_id")).alias("competing_fact_ids"))
    return groups.select(ops.content_id(*ops.GROUP).alias("id"), *ops.GROUP, "competing_fact_ids", F.lit("open").alias("status"))


def with_current_ends(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """``facts`` with the ends that were sent last; given ends stay."""
    ends = changed.where("kind = 'end'").groupBy(F.col("fact_id").alias("__fact")).agg(F.max_by("valid_to", "batch").alias("__end"))
    return facts.join(ends, facts.id == ends["__fact"], "left").withColumn("valid_to", F.coalesce("valid_to", "__end")).drop("__fact", "__end")
