"""Queries that run as streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_path
from ..streaming import keyed
from .queries import _DETECTED, _SUPERSEDED, FACTS, JOINED, facts, predicates, query


def _changed(spark, d):
    """The changes that all facts bring in three batches, each with facts of any day."""
    f = facts(spark, d)
    source, path = fresh_path(spark, "facts"), fresh_path(spark, "changes")
    thirds = -(-f.rdd.getNumPartitions() // 3)
    f.repartition(3 * thirds, "seq").write.parquet(source)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", thirds).parquet(source)
    keyed.detect_with_state(stream, predicates(spark), path, fresh_path(spark, "state")).awaitTermination()
    return f, keyed.read_changes(spark, path)


@query(FACTS + _DETECTED + " select id, subject_id, predicate, array_to_string(members, '|') as competing_fact_ids, 'open' as status from detected")
def stream_conflicts(spark, d):
    return keyed.current_conflicts(_changed(spark, d)[1]).withColumn("competing_fact_ids", JOINED("competing_fact_ids"))


@query(FACTS + _SUPERSEDED + " select id, seq, cast(valid_from as varchar) as valid_from, cast(valid_to as varchar) as valid_to from closed")
def stream_supersede(spark, d):
    return keyed.with_current_ends(*_changed(spark, d)).select("id", "seq", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))
