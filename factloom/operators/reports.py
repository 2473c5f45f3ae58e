"""Passes over a graph or a store that tell how much they changed; a dry run counts the same and writes nothing.

Counts are observed while a result is written, so they cost no pass of their own. A pass returns (report, path): the
report has one row, and the results are Parquet tables under the path, None for a dry run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import fresh_path, kept
from . import facts as O
from . import graph as G
from . import merges as M
from . import retrieval as R


def written(tables: dict[str, tuple[DataFrame, dict[str, Column]]], path: str | None) -> dict[str, int]:
    """Write each table to its folder of ``path``, or nowhere if that is None, and count the rows that meet its
    conditions on the way."""
    found = {}
    for name, (rows, conditions) in tables.items():
        seen = Observation(name)
        out = rows.observe(seen, *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()))
        if path:
            out.write.parquet(f"{path}/{name}")
        else:
            out.write.format("noop").mode("overwrite").save()
        found |= seen.get
    return found


def _report(spark, counts: dict[str, int], dry_run: bool | None = None) -> DataFrame:
    row = counts if dry_run is None else counts | {"dry_run": dry_run}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long'}" for k, v in row.items()))


def _path(df: DataFrame, label: str, dry_run: bool) -> str | None:
    return None if dry_run else fresh_path(df.sparkSession, label)


def one_edge_each(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, with the columns of its first row as JSON has them, so that a plan that reads the edges
    twice has the same rows."""
    ends = (F.least("src", "tgt").alias("__a"), F.greatest("src", "tgt").alias("__b"))
    row = F.struct(*edges.columns)
    return edges.groupBy(*ends).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")


def post_process(nodes: DataFrame, edges: DataFrame, legal: list[str], dry_run: bool = False) -> tuple[DataFrame, str | None]:
    """Document ids from the paths of nodes (name, entity_type, file_path) and of each undirected edge (src, tgt,
    file_path), and legal types. Report: nodes_rewritten, edges_rewritten, entity_types_remapped."""
    kind, original, remapped = G.normal_type(F.col("entity_type"), legal)
    new = G.with_document_ids(nodes, R.document_ids(F.col("file_path"))).withColumns({"original_entity_type": original, "__remapped": remapped, "entity_type": kind})
    path = _path(nodes, "post-processed", dry_run)
    every = F.lit(True)
    counts = written({"nodes": (new, {"nodes_rewritten": every, "entity_types_remapped": F.col("__remapped")}),
                      "edges": (G.with_document_ids(one_edge_each(edges), R.document_ids(F.col("file_path"))), {"edges_rewritten": every})}, path)
    return _report(nodes.sparkSession, {k: counts[k] for k in ("nodes_rewritten", "edges_rewritten", "entity_types_remapped")}), path


def annotate(nodes: DataFrame, edges: DataFrame, dates: DataFrame, dry_run: bool = False) -> tuple[DataFrame, str | None]:
    """Dates of their documents before the descriptions of nodes (name, description, document_ids as text) and of each
    undirected edge (src, tgt, description, document_ids). Report: nodes_annotated, edges_annotated, dry_run."""
    path = _path(nodes, "annotated", dry_run)
    listed = lambda df: df.withColumn("document_ids", T.ids_of(F.col("document_ids")))
    links = one_edge_each(edges).withColumn("__edge", F.to_json(F.struct("src", "tgt")))
    counts = written({"nodes": (G.with_sources(listed(nodes), dates), {"nodes_annotated": F.col("annotated")}),
                      "edges": (G.with_sources(listed(links), dates, "__edge").drop("__edge"), {"edges_annotated": F.col("annotated")})}, path)
    return _report(nodes.sparkSession, counts, dry_run), path


def apply_plan(nodes: DataFrame, edges: DataFrame, overrides: DataFrame, plan: DataFrame, dry_run: bool = False) -> tuple[DataFrame, str | None]:
    """Types (name, bucket, new_type) and then merges (op, canonical, sources) applied to nodes (name, entity_type,
    description, document_ids) and edges (src, tgt). Report: types_applied, types_skipped, merges_applied,
    merges_skipped, merge_errors. Applying a plan again to its result changes nothing."""
    path = _path(nodes, "applied", dry_run)
    moved = M.moves(nodes, plan)
    is_ = lambda *outcome: F.col("outcome").isin(*outcome)
    counts = written({
        "type_changes": (G.type_changes(nodes, overrides), {"types_applied": is_("change"), "types_skipped": is_("skip", "missing")}),
        "merges": (M.outcomes(nodes, plan, moved), {"merges_applied": is_("applied"), "merges_skipped": is_("skipped"), "merge_errors": is_("error")})}, path)
    if path:
        written({"nodes": (M.merged(G.with_types(nodes, overrides), moved), {"n": F.lit(True)}), "edges": (M.moved_edges(edges, moved), {"n": F.lit(True)})}, path)
    return _report(nodes.sparkSession, counts), path


def apply_replacements(facts: DataFrame, conflicts: DataFrame, chains: DataFrame, dates: DataFrame, predicates: DataFrame, dry_run: bool = False) -> tuple[DataFrame, str | None]:
    """Ends of replaced facts and open conflicts they settle. Report: facts_updated, conflicts_resolved."""
    path = _path(facts, "replaced", dry_run)
    replaced = kept(O.replacements(facts, chains, dates, predicates))
    before = facts.select("id", F.col("valid_to").alias("__before"))
    ended = O.with_replaced_ends(facts, replaced).join(before, "id")
    settled = O.resolve_replaced(conflicts, replaced)
    counts = written({"facts": (ended, {"facts_updated": F.col("__before").isNull() & F.col("valid_to").isNotNull()}),
                      "conflicts": (settled, {"conflicts_resolved": F.col("resolution").isNotNull()})}, path)
    return _report(facts.sparkSession, counts), path
