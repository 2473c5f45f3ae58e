"""Entity graphs: degrees, types, provenance prefixes, alias clusters, merges and index nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

#: Types whose names may be merged, and types that say little (the last two are index nodes themselves).
CLUSTERABLE = ("person", "organization", "location", "concept", "document")
LOW_SIGNAL = ("amount", "date", "identifier")
INDEX_TYPES = ("entity_profile", "catalog_index")
MERGE_THRESHOLD = 0.85
#: Entities of a word that travel together.
TILE = 1024
SHOWN_DOCUMENTS, SHOWN_MEMBER_DOCUMENTS, SHOWN_ENTITIES = 20, 8, 40


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, from its smaller to its larger end."""
    return edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, entity_type, degree), 0 for isolated nodes."""
    ends = undirected(edges).select(F.explode(F.array("src", "tgt")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("d"))
    return nodes.join(ends, "name", "left").select("name", "entity_type", F.coalesce("d", F.lit(0)).cast("long").alias("degree"))


def type_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce(F.when(F.col("entity_type") != "", F.col("entity_type")), F.lit("null")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


def diagnosis(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """By type: entities, mean degree to two places, isolated entities, distinct documents."""
    by_type = degrees(nodes, edges).groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"), F.round(F.avg("degree"), 2).alias("mean_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))
    docs = nodes.select("name", "entity_type").join(membership, "name").groupBy("entity_type").agg(F.count_distinct("document_id").alias("documents"))
    return by_type.join(docs, "entity_type", "left").withColumn("documents", F.coalesce("documents", F.lit(0)).cast("long"))


def top_by_degree(nodes: DataFrame, edges: DataFrame, n: int = 40) -> DataFrame:
    """The ``n`` nodes of highest degree, ties by name (a top-k report)."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "name").limit(n)


def isolation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities, how many have edges and how many are isolated."""
    return degrees(nodes, edges).agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("degree") > 0).alias("with_edges"), F.count_if(F.col("degree") == 0).alias("isolated"))


def document_dates(docs: DataFrame) -> DataFrame:
    """(document_id, document_date) of the documents whose date is an ISO date; others are left out."""
    day = F.when(F.col("document_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("document_date", "yyyy-MM-dd"))
    return docs.where(F.coalesce("document_id", F.lit("")) != "").select("document_id", day.alias("document_date")).where("document_date is not null")


def lenient_date(raw: Column) -> Column:
    """The day of an ISO date or date and time; null where it is none."""
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}(T.*)?$"), F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"))


def membership(nodes: DataFrame) -> DataFrame:
    """(name, document_id) of nodes (name, document_ids) with ids as an array."""
    return nodes.select("name", F.explode(F.array_distinct("document_ids")).alias("document_id"))


def sourced_prefix(membership: DataFrame) -> DataFrame:
    """'[sourced: d1, d2] ' of each name from its documents' distinct dates, ascending."""
    days = F.array_sort(F.collect_set(F.col("document_date").cast("string")))
    return membership.where("document_date is not null").groupBy("name").agg(F.concat(F.lit("[sourced: "), F.array_join(days, ", "), F.lit("] ")).alias("prefix"))


def with_sources(records: DataFrame, dates: DataFrame, key: str = "name") -> DataFrame:
    """Records (key, description, document_ids as an array) with the prefix of their documents' dates before the
    description, and ``annotated``. One that has a prefix already, or no dated document, stays as it is."""
    rows = records.select(F.col(key).alias("name"), F.explode(F.array_distinct("document_ids")).alias("document_id")).join(dates, "document_id")
    prefix = sourced_prefix(rows).withColumnRenamed("name", "__name")
    out = records.join(prefix, records[key] == F.col("__name"), "left")
    annotated = F.col("prefix").isNotNull() & ~F.coalesce("description", F.lit("")).startswith("[sourced:")
    text = F.when(annotated, F.concat("prefix", F.coalesce("description", F.lit("")))).otherwise(F.col("description"))
    return out.withColumns({"description": text, "annotated": annotated}).drop("prefix", "__name")


def without_source_prefix(description: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(description), r"^\[sourced:[^\]]*\]", ""))


def with_document_ids(records: DataFrame, path_ids: Column) -> DataFrame:
    """Records with document_ids, '<SEP>'-joined, from their paths."""
    return records.withColumn("document_ids", T.joined_ids(path_ids))


def normal_type(raw: Column, legal: list[str]) -> tuple[Column, Column, Column]:
    """(type, original, remapped): trimmed and lower-cased; one that isn't legal becomes 'concept', and what it was,
    unless empty, is the original."""
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    known = t.isin([x.lower() for x in legal])
    return F.when(known, t).otherwise("concept"), F.when(~known & (t != ""), t), ~known


def is_index_node(name: Column) -> Column:
    return name.startswith("Profile: ") | name.startswith("Catalog: ")


def document_line(document_id: Column, filename: Column, day: Column, context: Column) -> Column:
    """'  - /store/<id>/content.md (name, date=..., context=a/b)' with what is known."""
    bits = F.concat_ws(", ", F.when(filename != "", filename), F.when(day.cast("string") != "", F.concat(F.lit("date="), day.cast("string"))), F.when(F.size(context) > 0, F.concat(F.lit("context="), F.array_join(context, "/"))))
    return F.concat(F.lit("  - /store/"), document_id, F.lit("/content.md"), F.when(bits != "", F.concat(F.lit(" ("), bits, F.lit(")"))).otherwise(""))


def _indexed(nodes: DataFrame, docs: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """(name, entity_type, document_id, line, at) of the nodes that say something, with each of their stored documents."""
    line = document_line(F.col("document_id"), F.coalesce("original_filename", F.lit("")), F.coalesce("document_date", F.lit("")), F.coalesce("doc_context", F.array().cast("array<string>")))
    shown = nodes.where(~F.coalesce("entity_type", F.lit("")).isin([*LOW_SIGNAL, *INDEX_TYPES, *hidden]) & ~is_index_node(F.col("name")))
    rows = shown.select("name", F.coalesce("entity_type", F.lit("")).alias("entity_type"), F.posexplode("document_ids").alias("at", "document_id"))
    return rows.join(docs.select("document_id", line.alias("line")), "document_id")


def profile_nodes(nodes: DataFrame, docs: DataFrame, least: int = 2, hidden: tuple[str, ...] = ()) -> DataFrame:
    """An index node (name, entity_type, description, source_id, document_ids) for each entity of ``least`` stored
    documents or more: the first 20 by id, a line each, and how many more there are."""
    d = F.array_sort(F.collect_list(F.struct("document_id", "line")))
    rows = _indexed(nodes, docs, hidden).groupBy("name", "entity_type").agg(d.alias("d"), F.array_sort(F.collect_list(F.struct("at", "document_id"))).alias("o")).where(F.size("d") >= least)
    lines = F.transform(F.slice("d", 1, SHOWN_DOCUMENTS), lambda x: x["line"])
    more = F.when(F.size("d") > SHOWN_DOCUMENTS, F.array(F.concat(F.lit("  \u2026and "), (F.size("d") - SHOWN_DOCUMENTS).cast("string"), F.lit(" more.")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("Profile of "), "name", F.lit(" (type: "), "entity_type", F.lit(").")), F.concat(F.lit("Appears in "), F.size("d").cast("string"), F.lit(" documents:")))
    return rows.select(F.concat(F.lit("Profile: "), "name").alias("name"), F.lit("entity_profile").alias("entity_type"), F.array_join(F.concat(head, lines, more), "\n").alias("description"),
                       F.col("o")[0]["document_id"].alias("source_id"), F.transform("o", lambda x: x["document_id"]).alias("document_ids"))


def catalog_nodes(nodes: DataFrame, docs: DataFrame, least: int = 2, hidden: tuple[str, ...] = ()) -> DataFrame:
    """An index node for each type of ``least`` entities and documents or more, a line an entity with its first 8
    documents."""
    rows = _indexed(nodes, docs, hidden)
    path = F.transform(F.slice(F.array_sort(F.collect_list("document_id")), 1, SHOWN_MEMBER_DOCUMENTS), lambda d: F.concat(F.lit("/store/"), d, F.lit("/content.md")))
    members = rows.groupBy("entity_type", "name").agg(F.concat(F.lit("  - "), "name", F.lit(" ["), F.array_join(path, ", "), F.lit("]")).alias("line"))
    members = members.groupBy("entity_type").agg(F.array_sort(F.collect_list(F.struct("name", "line"))).alias("m"))
    own = rows.groupBy("entity_type").agg(F.array_sort(F.collect_set("document_id")).alias("d"))
    both = members.join(own, "entity_type").where((F.size("m") >= least) & (F.size("d") >= least))
    head = F.array(F.concat(F.lit("Catalog of "), "entity_type", F.lit(" entities across the corpus.")), F.concat(F.size("m").cast("string"), F.lit(" entities found across "), F.size("d").cast("string"), F.lit(" documents:")))
    return both.select(F.concat(F.lit("Catalog: "), "entity_type").alias("name"), F.lit("catalog_index").alias("entity_type"), F.array_join(F.concat(head, F.transform("m", lambda x: x["line"])), "\n").alias("description"), F.col("d")[0].alias("source_id"), F.col("d").alias("document_ids"))


def index_plan(nodes: DataFrame, docs: DataFrame, least_docs: int = 2, least_entities: int = 2, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Profiles, then catalogs, each by name (kind, name order): what is to replace the index nodes there are."""
    both = profile_nodes(nodes, docs, least_docs, hidden).withColumn("kind", F.lit(0)).unionByName(catalog_nodes(nodes, docs, least_entities, hidden).withColumn("kind", F.lit(1)))
    return both.orderBy("kind", "name")


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of equal keys."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def with_index_nodes(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """``nodes`` without the index nodes they have and with those of the plan."""
    return nodes.where(~is_index_node(F.col("name"))).unionByName(plan.drop("kind"), allowMissingColumns=True)


def summaries(docs: DataFrame, nodes: DataFrame, extras: DataFrame | None = None, hidden: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, full_doc_id, file_path, content) of each document: name, date, id, quality, context, its first 40
    telling entities by name and, from ``extras`` (document_id, at, line), its highlights."""
    telling = nodes.where(~F.coalesce("entity_type", F.lit("")).isin([*LOW_SIGNAL, *hidden])).select("name", F.explode(F.array_distinct("document_ids")).alias("document_id"))
    names = telling.groupBy("document_id").agg(F.slice(F.array_sort(F.collect_list("name")), 1, SHOWN_ENTITIES).alias("names"))
    rows = docs.where(F.coalesce("document_id", F.lit("")) != "").join(names, "document_id", "left")
    if extras is not None:
        rows = rows.join(extras.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: F.concat(F.lit("  - "), x["line"])).alias("lines")), "document_id", "left")
    else:
        rows = rows.withColumn("lines", F.lit(None).cast("array<string>"))
    known = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", "unknown").otherwise(F.col(c).cast("string"))
    name = known("original_filename")
    content = F.concat_ws(
        "\n", F.concat(F.lit("Document: "), name), F.concat(F.lit("Filename tokens: "), F.translate(name, "_-", "  ")), F.concat(F.lit("Document date: "), known("document_date")),
        F.concat(F.lit("Document ID: "), "document_id"), F.concat(F.lit("Extraction quality: "), known("extraction_quality")),
        F.when(F.size("doc_context") > 0, F.concat(F.lit("Document context: "), F.array_join("doc_context", ", "))),
        F.when(F.size("names") > 0, F.concat(F.lit("Key entities: "), F.array_join("names", ", "))),
        F.when(F.size("lines") > 0, F.concat(F.lit("Structured highlights:\n"), F.array_join("lines", "\n"))))
    return rows.select(F.concat(F.lit("summary-"), "document_id").alias("chunk_id"), F.col("document_id").alias("full_doc_id"), F.concat(F.lit("/store/"), "document_id", F.lit("/content.md")).alias("file_path"), content.alias("content"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _scored(threshold: float):
    """Pairs (a, b, score) of two tiles of entities: names are lexically equal, scores at least nearly ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(0).to_pylist()
            for r in range(batch.num_rows):
                (x, nx, vx), (y, ny, vy) = (_unpacked(batch.column(c)[r].values, m[r]) for c in (1, 2))
                kx, ky = (np.array([n.count(" ") for n in names]) for names in (nx, ny))
                # a pair is met at the rarest word of the name with fewer words, one of equal names from its smaller id
                i, j = np.nonzero((kx[:, None] < ky) | ((kx[:, None] == ky) & (x[:, None] < y)))
                score = (vx @ vy.T)[i, j]
                near = ~(score < threshold - 1e-4)  # not a number is the largest, as to Spark
                i, j, score = i[near], j[near], score[near]
                known: dict[tuple[str, str], bool] = {}
                named = kx[i] == 0  # the one word of a name is the word they are met at
                more = np.flatnonzero(~named)
                named[more] = [_equal(nx[p], ny[q], known) for p, q in zip(i[more].tolist(), j[more].tolist())]
                i, j, score = i[named], j[named], score[named]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[i], y[j])), pa.array(np.maximum(x[i], y[j])), pa.array(score)], ["a", "b", "score"])

    return run


def _unpacked(rows: pa.StructArray, m: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    ids, names, vectors = rows.flatten()
    return ids.to_numpy(zero_copy_only=False), names.to_pylist(), vectors.flatten().to_numpy().reshape(len(ids), m)


def _equal(short: str, long: str, known: dict[tuple[str, str], bool]) -> bool:
    """Whether the words of a normal name come in this order in another."""
    if (short, long) not in known:
        rest = iter(long.split(" "))
        known[short, long] = all(w in rest for w in short.split(" "))
    return known[short, long]


def alias_edges(entities: DataFrame, threshold: float = MERGE_THRESHOLD, types: tuple[str, ...] | None = CLUSTERABLE) -> DataFrame:
    """(a, b, score) of entities (id, name, entity_type, embedding of unit length) of one type with lexically equal
    names and a cosine of ``threshold`` or more.

    All words of the name with fewer are in the other, so a pair is met at the rarest of them, by an equi-join on type
    and word; no two entities without a word in common are ever compared. Entities travel in tiles, a tile of one side
    meets those of the other in a task, and only pairs that hold leave it.
    """
    rows = entities if types is None else entities.where(F.col("entity_type").isin(list(types)))
    vector = F.col("embedding").cast("array<double>")
    rows = rows.select("id", "entity_type", T.normal_name("name").alias("n"), vector.alias("v")).where((F.col("n") != "") & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    words = rows.select("*", F.size("v").alias("m"), F.explode(F.array_distinct(F.split("n", " "))).alias("word"))
    df = words.groupBy("entity_type", "word").agg(F.count(F.lit(1)).alias("df"))
    words = words.join(df, ["entity_type", "word"]).withColumn("tiles", F.ceil(F.col("df") / TILE).cast("int"))
    rare = words.groupBy("id", "entity_type", "n").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    key = ["entity_type", "word", "m", "tile"]
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    packed = lambda t, name: t.withColumn("tile", tile).groupBy(*key, "tiles").agg(F.collect_list(F.struct("id", "n", "v")).alias(name))
    few = packed(words.join(rare, ["id", "entity_type", "n", "word"]), "few").drop("tiles")
    every = packed(words, "every").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = few.join(every, key).select("m", "few", "every").mapInArrow(_scored(threshold), f"a {_kind(rows)}, b {_kind(rows)}, score double")
    return met.withColumn("score", F.round("score", 4)).where(F.col("score") >= threshold)


def _kind(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def _near(edges: DataFrame) -> DataFrame:
    """(a, near): the sorted neighbours of each node that has any."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    return both.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("near"))


def _with_all_edges(sets: DataFrame, pairs: DataFrame, n: Column, edges: DataFrame) -> DataFrame:
    """Those of ``sets`` of which all ``n`` of the ``pairs`` (set, u, v) are edges."""
    there = pairs.join(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), ["u", "v"]).groupBy("set").agg(F.count(F.lit(1)).alias("__n"))
    return sets.join(there, "set").where(F.col("__n") == n).drop("__n")


def _cliques(near: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, members) of the nodes of ``near`` whose neighbours are all neighbours of each other, with these and itself.

    All their neighbours have theirs too, so none has fewer. Nodes of the same members are looked at once. Members that
    follow each other have to be neighbours, which hardly any set passes that doesn't have all edges; then all pairs.
    """
    least = near.select(F.explode("near").alias("a"), F.size("near").alias("d")).groupBy("a").agg(F.min("d").alias("d"))
    able = near.join(least, "a").where(F.size("near") <= F.col("d"))
    sets = able.groupBy(F.array_sort(F.array_append("near", F.col("a"))).alias("members")).agg(F.collect_list("a").alias("nodes"), F.min("a").alias("set"))
    sets, size = written(sets, "sets"), F.size("members").cast("long")
    follow = F.zip_with(F.slice("members", F.lit(1), F.size("members") - 1), F.slice("members", F.lit(2), F.size("members") - 1), lambda u, v: F.struct(u.alias("u"), v.alias("v")))
    pairs = written(sets.select("set", F.inline(follow)), "pairs")
    sets = written(_with_all_edges(sets, pairs, size - 1, edges), "sets")
    pairs = sets.select("set", "members", F.posexplode("members").alias("at", "u")).select("set", "u", F.explode(F.slice("members", F.col("at") + 2, F.size("members"))).alias("v"))
    return _with_all_edges(sets, pairs, size * (size - 1) / 2, edges).select(F.explode("nodes").alias("a"), "members")


def ambiguous(edges: DataFrame) -> DataFrame:
    """Nodes with two neighbours that are no neighbours of each other (edges from the smaller to the larger end)."""
    edges = written(edges.select("a", "b"), "edges")
    near = written(_near(edges), "near")
    return near.join(_cliques(near, edges), "a", "left_anti").select(F.col("a").alias("name"))


def ambiguous_groups(edges: DataFrame) -> DataFrame:
    """(members): each ambiguous node with all its neighbours, sorted, every such group once."""
    edges = written(edges.select("a", "b"), "edges")
    near = written(_near(edges), "near")
    return near.join(_cliques(near, edges), "a", "left_anti").select(F.array_sort(F.array_append("near", F.col("a"))).alias("members")).distinct()


def alias_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, cluster): the smallest name among a node and its neighbours once ambiguous nodes are out, as what is left
    is transitive; ambiguous nodes stand alone."""
    edges = written(edges.select("a", "b"), "edges")
    near = written(_near(edges), "near")
    safe = written(_cliques(near, edges), "safe")
    both = safe.select("a", F.explode("members").alias("b")).join(safe.select(F.col("a").alias("b")), "b", "left_semi")
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(least, nodes.name == least.a, "left").select("name", F.least("name", F.coalesce("m", "name")).alias("cluster"))


def canonical(names: Column) -> Column:
    """The longest name, ties to the smallest first character, then to the first in order."""
    ranked = F.transform(names, lambda n, i: F.struct((-F.length(n)).alias("l"), F.substring(n, 1, 1).alias("c"), i.alias("i"), n.alias("n")))
    return F.array_min(ranked)["n"]


def merge_plan(clusters: DataFrame) -> DataFrame:
    """(op, canonical, sources) of each cluster (name, cluster) of two names or more; no two share a name, so any order of
    the merges is good."""
    rows = clusters.groupBy("cluster").agg(F.array_sort(F.collect_list("name")).alias("names")).where(F.size("names") > 1)
    return rows.select(canonical(F.col("names")).alias("canonical"), "names").select(F.xxhash64("canonical").alias("op"), "canonical", F.array_remove("names", F.col("canonical")).alias("sources"))


def last_override(overrides: DataFrame) -> DataFrame:
    """The override of each name from the latest bucket."""
    return overrides.withColumn("__n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("bucket")))).where("__n = 1").drop("__n")


def with_types(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """``nodes`` with the types that overrides (name, bucket, new_type) give them; the latest bucket wins."""
    last = last_override(overrides).select("name", "new_type")
    return nodes.join(last, "name", "left").withColumn("entity_type", F.coalesce("new_type", "entity_type")).drop("new_type")


def type_buckets(nodes: DataFrame, fallback: str = "concept") -> DataFrame:
    """(bucket, names): nodes of the fallback type, and those of them that had another; empty ones are left out."""
    rows = nodes.where(F.col("entity_type") == fallback)
    remapped = rows.where(F.coalesce("original_entity_type", F.lit("")) != "")
    both = rows.select(F.lit("concept_fallback").alias("bucket"), "name").union(remapped.select(F.lit("remapped_singletons"), "name"))
    return both.groupBy("bucket").agg(F.array_sort(F.collect_list("name")).alias("names"))


def type_changes(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """(name, old_type, new_type, outcome): missing nodes warn, equal types are skipped."""
    rows = last_override(overrides).join(nodes.select("name", F.col("entity_type").alias("old_type")), "name", "left")
    outcome = F.when(F.col("old_type").isNull(), "missing").when(F.col("old_type") == F.col("new_type"), "skip").otherwise("change")
    return rows.select("name", "old_type", "new_type", outcome.alias("outcome"))
