"""Merges applied in order: which of a plan's merges take place, where every node ends, and what each merge came to.

A merge (op, canonical, sources) moves the sources that are still there into a canonical node that is still there. A
move of a source holds unless an earlier move took the source or the canonical away, so it waits for the earlier moves
of both. Rounds decide all moves whose earlier ones are decided; one that waits for a single other is its opposite, and
such chains are followed by pointer jumping, as are the moves that hold from each node to where it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .graph import undirected


def _sources(plan: DataFrame) -> Column:
    return F.array_distinct(F.filter("sources", lambda s: s.isNotNull() & (s != F.col("canonical"))))


def moves(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """(op, at, source, canonical) of the moves of a plan (op, canonical, sources) that take place among ``nodes``
    (name). ``op`` orders the merges and no two share one; ``at`` is the source's place in its merge."""
    names = nodes.select("name").distinct()
    rows = plan.select("op", "canonical", F.posexplode(_sources(plan)).alias("at", "source"))
    rows = rows.join(names, rows.source == names.name, "left_semi").join(names, rows.canonical == names.name, "left_semi")
    key = F.struct("op", "source")
    state = rows.select(key.alias("e"), "op", "at", "source", "canonical", F.lit(None).cast("boolean").alias("holds"), F.lit(None).cast("boolean").alias("opposite"))
    state = kept(state.withColumn("waits_for", F.when(F.lit(False), F.col("e"))))
    while not state.where("holds is null").isEmpty():
        state = kept(_jumped(_decided(state)))
    return state.where("holds").select("op", "at", "source", "canonical")


def _decided(state: DataFrame) -> DataFrame:
    """Moves whose earlier ones are decided get decided; those with one undecided before them wait for it."""
    open_ = F.col("holds").isNull()
    marks = state.where("holds is null or holds").select(F.col("source").alias("node"), "op", F.lit(1).alias("turn"), "holds", F.when(open_, F.col("e")).alias("undecided"))
    asks = state.where(open_).select(F.explode(F.array("source", "canonical")).alias("node"), "op", F.lit(0).alias("turn"), F.col("e").alias("asks"))
    before = Window.partitionBy("node").orderBy("op", "turn").rowsBetween(Window.unboundedPreceding, -1)
    seen = marks.unionByName(asks, allowMissingColumns=True).select(
        "asks", F.max("holds").over(before).alias("gone"), F.count("undecided").over(before).alias("n"), F.last("undecided", ignorenulls=True).over(before).alias("last"))
    told = seen.where("asks is not null").groupBy("asks").agg(F.max(F.coalesce("gone", F.lit(False))).alias("gone"), F.sum("n").alias("n"), F.max("last").alias("last"))
    rows = state.join(told, state.e == told.asks, "left")
    holds = F.when(open_ & F.col("gone"), F.lit(False)).when(open_ & (F.col("n") == 0), F.lit(True)).otherwise(F.col("holds"))
    alone = F.col("waits_for").isNull() & (F.col("n") == 1)
    return rows.withColumns({"holds": holds, "opposite": F.when(alone, F.lit(True)).otherwise(F.col("opposite")), "waits_for": F.when(alone, F.col("last")).otherwise(F.col("waits_for"))}).select(*state.columns)


def _jumped(state: DataFrame) -> DataFrame:
    """Moves that wait for one that is decided get decided, others wait for what that one waits for."""
    to = state.select(F.col("e").alias("t"), F.col("holds").alias("t_holds"), F.col("opposite").alias("t_opposite"), F.col("waits_for").alias("t_waits_for"))
    rows = state.join(to, state.waits_for == to.t, "left")
    further = F.col("t_waits_for").isNotNull()
    return rows.withColumns({
        "holds": F.coalesce("holds", F.col("t_holds") != F.col("opposite")), "opposite": F.when(further, F.col("opposite") != F.col("t_opposite")).otherwise(F.col("opposite")),
        "waits_for": F.when(further, F.col("t_waits_for")).otherwise(F.col("waits_for"))}).select(*state.columns)


def ends(moved: DataFrame) -> DataFrame:
    """(name, root, path): where each moved node ends, and the (op, at) of the moves from there back to it, by which
    what the root takes in is in order."""
    found = kept(moved.select(F.col("source").alias("name"), F.col("canonical").alias("root"), F.array(F.struct("op", "at")).alias("path")))
    while True:
        on = found.select(F.col("name").alias("n"), F.col("root").alias("r"), F.col("path").alias("p"))
        rows = found.join(on, found.root == on.n, "left")
        if rows.where("r is not null").isEmpty():
            return found
        found = kept(rows.select("name", F.coalesce("r", "root").alias("root"), F.when(F.col("p").isNotNull(), F.concat("p", "path")).otherwise(F.col("path")).alias("path")))


def merged(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """``nodes`` (name, entity_type, description, document_ids) after the moves: a node keeps its type and has all
    descriptions, its own first and then, merge by merge, those of what was moved into it, and all distinct documents."""
    to = ends(moved)
    rows = nodes.join(to, "name", "left").withColumns({"target": F.coalesce("root", "name"), "path": F.coalesce("path", F.expr("cast(array() as array<struct<op:bigint,at:int>>)"))})
    rows = rows.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("path", "entity_type", "description", "document_ids"))).alias("m"))
    texts = F.filter(F.transform("m", lambda x: x["description"]), lambda t: t.isNotNull() & (t != ""))
    return rows.select(F.col("target").alias("name"), F.col("m")[0]["entity_type"].alias("entity_type"), F.array_join(texts, "<SEP>").alias("description"),
                       F.array_distinct(F.flatten(F.transform("m", lambda x: x["document_ids"]))).alias("document_ids"), F.size("m").cast("long").alias("members"))


def moved_edges(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """``edges`` (src, tgt) between the nodes their ends come to; loops go, each pair is left once."""
    to = ends(moved).select("name", "root")
    for end in ("src", "tgt"):
        edges = edges.join(to, edges[end] == to.name, "left").withColumn(end, F.coalesce("root", end)).drop("root", "name")
    return undirected(edges.where("src <> tgt"))


def outcomes(nodes: DataFrame, plan: DataFrame, moved: DataFrame) -> DataFrame:
    """(op, canonical, live_sources, outcome) of each merge: 'skipped' where no source was there any more, 'error' where
    the canonical node wasn't, else 'applied'."""
    there = nodes.select("name").distinct().join(moved.select(F.col("source").alias("name"), F.col("op").alias("left_at")), "name", "left")
    rows = plan.select("op", "canonical", F.explode_outer(_sources(plan)).alias("source"))
    rows = rows.join(there.select(F.col("name").alias("source"), F.lit(1).alias("known"), "left_at"), "source", "left")
    live = F.count_if(F.col("known").isNotNull() & (F.col("left_at").isNull() | (F.col("left_at") >= F.col("op")))).alias("live_sources")
    rows = rows.groupBy("op", "canonical").agg(live).join(there.withColumnRenamed("name", "canonical").withColumn("known", F.lit(1)), "canonical", "left")
    gone = F.col("known").isNull() | (F.col("left_at") < F.col("op"))
    return rows.select("op", "canonical", "live_sources", F.when(F.col("live_sources") == 0, "skipped").when(gone, "error").otherwise("applied").alias("outcome"))
