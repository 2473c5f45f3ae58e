"""Corrections as tables: overlays over sources, decisions on types, aliases and conflicts, and their overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .documents import overlaid, with_headers
from .graph import canonical

_NONE = "cast(array() as array<string>)"
#: Source corrections: document_id, original_filename, status, doubts, metadata (map), tags, replaced_by,
#: override_path, replacements. Alias corrections: cluster, members, status, action, canonical, split_groups.


def with_metadata_overlay(documents: DataFrame, corrections: DataFrame) -> DataFrame:
    """Documents (document_id, metadata as a map, tags) with what corrections say: their metadata win, their tags are
    appended unless there, replaced_by is set. Documents without a correction stay as they are."""
    own = corrections.select("document_id", F.col("metadata").alias("__metadata"), F.col("tags").alias("__tags"), F.nullif("replaced_by", F.lit("")).alias("replaced_by"))
    rows = documents.join(own, "document_id", "left")
    over = F.coalesce("__metadata", F.expr("cast(map() as map<string,string>)"))
    both = F.map_concat(F.map_filter("metadata", lambda k, v: ~F.map_contains_key(over, k)), over)
    tags = F.array_union(F.coalesce("tags", F.expr(_NONE)), F.coalesce("__tags", F.expr(_NONE)))
    return rows.withColumns({"metadata": both, "tags": F.when(F.size("__tags") > 0, tags).otherwise(F.col("tags"))}).drop("__metadata", "__tags")


def resolved_content(documents: DataFrame, corrections: DataFrame, bodies: DataFrame) -> DataFrame:
    """Documents (document_id, content) with the body (path, body) that their correction names, if it is there, in place
    of their own, and then its literal replacements."""
    own = corrections.select("document_id", F.col("override_path").alias("path"), "replacements")
    # bodies meet the corrections that name one: documents would all meet in one task if they name none
    named = own.where("path is not null").join(bodies.select("path", "body"), "path", "left")
    own = named.select("document_id", "body", "replacements").unionByName(own.where("path is null").drop("path"), allowMissingColumns=True)
    rows = documents.join(own, "document_id", "left")
    return rows.withColumn("content", overlaid(F.coalesce("body", "content"), F.col("replacements"))).drop("body", "replacements")


def prepared(documents: DataFrame, corrections: DataFrame, bodies: DataFrame, hints: Column) -> DataFrame:
    """(document_id, file_path, body, overlaid, focused) of documents (document_id, content, metadata, tags) as they go to
    extraction: metadata and content as corrected, and before the text the date of the metadata and the types that
    ``hints``, over the corrected columns, names. ``overlaid`` tells whether another body was named, ``focused`` whether
    there are types."""
    rows = with_metadata_overlay(documents, corrections).drop("replaced_by")
    rows = resolved_content(rows, corrections, bodies).withColumn("__types", hints)
    named = corrections.select("document_id", (F.coalesce("override_path", F.lit("")) != "").alias("__named"))
    rows = rows.join(named, "document_id", "left")
    body = with_headers(F.coalesce("content", F.lit("")), F.col("metadata")["document_date"], F.col("__types"))
    return rows.select("document_id", F.concat(F.lit("/store/"), "document_id", F.lit("/content.md")).alias("file_path"), body.alias("body"), F.coalesce("__named", F.lit(False)).alias("overlaid"), (F.size("__types") > 0).alias("focused"))


def merged_doubts(stored: DataFrame, emitted: DataFrame) -> DataFrame:
    """Corrections (document_id, original_filename, status, doubts, overrides) after doubts (document_id,
    original_filename, doubts) were emitted anew: these replace the old ones, status and overrides stay, and a document
    without a correction gets a pending one."""
    new = emitted.select("document_id", F.col("original_filename").alias("__name"), F.col("doubts").alias("__doubts"))
    rows = stored.join(new, "document_id", "full")
    known = F.col("status").isNotNull()
    return rows.select("document_id", F.coalesce("original_filename", "__name").alias("original_filename"), F.coalesce("status", F.lit("pending")).alias("status"),
                       F.when(known, F.coalesce("__doubts", "doubts")).otherwise(F.col("__doubts")).alias("doubts"), "overrides")


def refreshed_entries(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries (bucket, name, ...) as the graph has them now, with the override_type that was set for them."""
    old = stored.select("bucket", "name", F.col("override_type"))
    return fresh.drop("override_type").join(old, ["bucket", "name"], "left")


def alias_corrections(groups: DataFrame) -> DataFrame:
    """(cluster, members, status) of ambiguous groups (members, sorted): named by the slug of the shortest member; the
    nth of one slug gets '_n'."""
    shortest = F.array_min(F.transform("members", lambda m: F.struct(F.length(m).alias("l"), m.alias("m"))))["m"]
    rows = groups.where(F.size("members") > 0).withColumn("slug", T.slug(shortest))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("members")))
    return rows.select(F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", "n")).alias("cluster"), "members", F.lit("pending").alias("status"))


def effective_action(action: Column) -> Column:
    return F.coalesce(F.nullif(action, F.lit("")), F.lit("accept"))


#: The actions that a decision on aliases may name.
ACTIONS = ("accept", "merge", "veto", "split")


def alias_decisions(corrections: DataFrame) -> DataFrame:
    """(cluster, members, status, action, canonical, split_groups, refused) of alias corrections (cluster, members, status,
    overrides as JSON): what the overrides leave out, or set to null, is the default, which accepts what was inferred, hints at no
    canonical name and splits nothing; further keys are passed over.

    ``refused`` tells what is wrong, the first of "members" (none), "overrides" (no JSON object) and "action" (an
    unknown one, also an empty one), and is null for those to apply. Null or blank overrides are the defaults.
    """
    own = F.from_json("overrides", "action string, canonical string, split_groups array<array<string>>, broken string", {"columnNameOfCorruptRecord": "broken"})
    rows = corrections.withColumn("__own", own)
    refused = F.when(F.coalesce(F.size("members"), F.lit(0)) <= 0, "members").when(F.col("__own.broken").isNotNull(), "overrides").when(~F.col("__own.action").isin(*ACTIONS), "action")
    groups = F.coalesce("__own.split_groups", F.expr("cast(array() as array<array<string>>)"))
    return rows.select("cluster", "members", "status", F.coalesce("__own.action", F.lit("accept")).alias("action"), F.col("__own.canonical").alias("canonical"), groups.alias("split_groups"), refused.alias("refused"))


def merge_operations(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cluster, part, canonical, sources, warning) of decisions to merge or split: of the members in the graph the
    hinted canonical one, or the one picked, takes up the others; fewer than two present give no operation.

    A warning tells of members or a canonical that aren't there and of a split without groups.
    """
    groups = F.when(F.col("action") == "merge", F.array("members")).when(F.col("action") == "split", F.coalesce("split_groups", F.expr("cast(array() as array<array<string>>)")))
    rows = aliases.withColumn("action", effective_action(F.col("action"))).where(F.col("action").isin("merge", "split"))
    rows = rows.select("cluster", F.when(F.col("action") == "merge", F.nullif("canonical", F.lit(""))).alias("hint"), F.posexplode_outer(groups).alias("part", "group"))
    members = rows.where("group is not null").select("cluster", "part", F.posexplode("group").alias("at", "name")).join(nodes.select("name", F.lit(True).alias("there")).distinct(), "name", "left")
    seen = members.groupBy("cluster", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("at", "name")))), lambda x: x["name"]).alias("present"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.struct("at", "name")))), lambda x: x["name"]).alias("missing"))
    rows = rows.join(seen, ["cluster", "part"], "left")
    hinted = F.coalesce(F.array_contains("present", F.col("hint")), F.lit(False))
    chosen = F.when(hinted, F.col("hint")).otherwise(canonical(F.col("present")))
    enough = F.size("present") >= 2
    warning = F.concat_ws("; ", F.when(F.col("group").isNull(), "split without groups"), F.when(F.size("missing") > 0, F.concat(F.lit("not in graph: "), F.array_join("missing", ", "))),
                          F.when(enough & F.col("hint").isNotNull() & ~hinted, F.concat(F.lit("canonical not in graph: "), "hint")))
    rows = rows.select("cluster", "part", F.when(enough, chosen).alias("canonical"), "present", F.nullif(warning, F.lit("")).alias("warning"))
    return rows.select("cluster", "part", "canonical", F.when(F.col("canonical").isNotNull(), F.array_remove("present", F.col("canonical"))).alias("sources"), "warning").where("canonical is not null or warning is not null")


def resolved_conflicts(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """``conflicts`` with reviewed decisions (conflict_id, status, winner, coexist, temporal_supersede_order) applied:
    an order resolves them temporally, anything else manually. Decisions without a conflict change nothing."""
    made = decisions.where("status = 'reviewed'").select(F.col("conflict_id").alias("__id"), "winner", "coexist", "temporal_supersede_order")
    made = made.where("winner is not null or coexist is not null or temporal_supersede_order is not null")
    rows = conflicts.join(made, conflicts.id == F.col("__id"), "left")
    ordered = F.size(F.coalesce("temporal_supersede_order", F.expr(_NONE))) > 0
    said = F.struct(F.nullif("winner", F.lit("")).alias("winner"), F.when(F.col("coexist"), F.lit(True)).alias("coexist"), F.when(ordered, F.col("temporal_supersede_order")).alias("temporal_supersede_order"))
    given = F.col("__id").isNotNull()
    status = F.when(given & ordered, "resolved_temporally").when(given, "resolved_manually").otherwise(F.col("status"))
    return rows.withColumns({"status": status, "decision": F.when(given, said)}).drop("__id", "winner", "coexist", "temporal_supersede_order")


def review(sources: DataFrame, entries: DataFrame, aliases: DataFrame, everything: bool = False) -> DataFrame:
    """(layer, key, status, n, about) of the pending corrections, or all of them: a source's doubted fields, a bucket's
    entries and overrides, an alias group's members and action."""
    a = sources.select(F.lit("source").alias("layer"), F.col("document_id").alias("key"), "status", F.size("doubts").cast("long").alias("n"), F.coalesce(F.nullif(F.array_join(F.transform("doubts", lambda d: d["field"]), ", "), F.lit("")), F.lit("-")).alias("about"))
    b = entries.groupBy("bucket").agg(F.first("status").alias("status"), F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("override_type", F.lit("")) != "").alias("o"))
    b = b.select(F.lit("entity-types"), "bucket", "status", "n", F.concat(F.col("o").cast("string"), F.lit(" overridden")))
    c = aliases.select(F.lit("aliases"), "cluster", "status", F.size("members").cast("long"), F.concat(F.lit("action="), effective_action(F.col("action"))))
    rows = a.union(b).union(c)
    return rows if everything else rows.where("status = 'pending'")


def shown(reviewed: DataFrame, key: str) -> DataFrame:
    """The corrections of a key, in whatever layer."""
    return reviewed.where(F.col("key") == key)


def stats(reviewed: DataFrame) -> DataFrame:
    """(layer, pending, reviewed, entries) of the rows of ``review``."""
    return reviewed.groupBy("layer").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "reviewed").alias("reviewed"), F.sum("n").alias("entries"))
