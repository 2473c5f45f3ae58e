"""Conflict detection over a stream of facts: each micro-batch re-examines the groups it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import facts as ops


def detect_continuously(stream: DataFrame, read_facts: Callable[[], DataFrame], predicates: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that, for each batch of new facts, detects conflicts among all stored facts of the touched
    (subject, predicate) groups and hands them to ``write`` with the batch's number; a batch that runs again gives the
    same rows, so an overwrite by number is idempotent."""

    def each(batch: DataFrame, number: int) -> None:
        touched = batch.select(*ops.GROUP).distinct()
        known = read_facts().join(touched, ops.GROUP, "left_semi").unionByName(batch).dropDuplicates(["id"])
        write(ops.detect_conflicts(known, predicates), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
