"""Vector retrieval, stable reranking, references and retention of expected documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import kept
from .graph import dot
from .vector_index import Index, search

#: Fixed value: a version-4 id right under store/, at the beginning or after a slash, with a slash after it.
DOC_PATH = r"(?:^|/)store/([0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12})/"
#: Fixed value: a heading 'References' of any depth and all that follows.
REFERENCES_BLOCK = r"(?is)\n*#{1,6}\s*References\s*\n.*\z"
INDEX_NAME = r"^(?:Profile|Catalog): "


def top_k(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(question_id, vec_id, score, rank): the ``k`` nearest rows to each of ``questions``, ties to the smaller id. Each
    block of rows sends on its own nearest only (Spark limits ranked groups before the shuffle)."""
    asked = questions.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("__q"))
    rows = vectors.crossJoin(asked).select("question_id", "vec_id", F.round(dot("embedding", "__q"), 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def rerank(hits: DataFrame, score: Column, group: str, top: int | None) -> DataFrame:
    """Hits of each group by score, ties in index order; all of them if ``top`` is None or negative, none if it is 0."""
    ranked = hits.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "idx")))
    return ranked if top is None or top < 0 else ranked.where(F.col("rank") <= top)


def reranked_chunks(chunks: DataFrame, scores: DataFrame, group: str) -> DataFrame:
    """Chunks (group, idx, ...) with the (group, idx, relevance_score) that a reranker gave them, best first as rank;
    scores of places that no chunk has are dropped."""
    rows = chunks.join(scores.select(group, "idx", "relevance_score"), [group, "idx"])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("relevance_score"), "idx")))


def document_ids(text: Column) -> Column:
    """Document ids directly under store/, in order, each once; none for a null."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOC_PATH), 1))


def hit_documents(document_ids_field: Column, file_path: Column, full_doc_id: Column) -> Column:
    """All document ids of a hit: its id field, its paths, whole or under store/, and the document of a chunk."""
    return F.array_distinct(F.array_compact(F.concat(T.ids_of(document_ids_field), document_ids(file_path), T.ids_of(file_path), F.array(full_doc_id))))


def retained(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(question, prefix, seen): whether a hit's file name begins with the expected prefix, both in normal form C. Names
    are cut to the lengths of their question's prefixes, so that equal beginnings are joined."""
    wanted = expected.withColumn("__prefix", T.composed("prefix"))
    lengths = wanted.groupBy(F.col("question").alias("q")).agg(F.collect_set(F.length("__prefix")).alias("__lengths"))
    names = hits.select("q", T.composed("file_name").alias("__name")).distinct().join(lengths, "q").select("q", "__name", F.explode("__lengths").alias("__n"))
    cut = names.where(F.length("__name") >= F.col("__n")).select("q", F.substring("__name", F.lit(1), F.col("__n")).alias("__cut")).distinct()
    met = wanted.join(cut, (F.col("question") == F.col("q")) & (F.col("__prefix") == F.col("__cut")), "left")
    return met.groupBy("question", "prefix").agg(F.max(F.col("__cut").isNotNull()).alias("seen"))


def with_filenames(cited: DataFrame, names: DataFrame) -> DataFrame:
    """Cited documents (document_id) with their original_filename, or the id where none is known."""
    return cited.join(names.select("document_id", "original_filename"), "document_id", "left").withColumn("filename", F.coalesce("original_filename", "document_id")).drop("original_filename")


def trace(stages: dict[str, DataFrame], expected: DataFrame, names: DataFrame) -> DataFrame:
    """(stage, question, prefix, seen) for each stage's hits (question, document_id)."""
    out = None
    for stage, hits in stages.items():
        named = with_filenames(hits, names).select(F.col("question").alias("q"), F.col("filename").alias("file_name"))
        rows = retained(named, expected).select(F.lit(stage).alias("stage"), "question", "prefix", "seen")
        out = rows if out is None else out.unionByName(rows)
    return out


def parsed_references(raw: Column) -> Column:
    """References {reference_id, file_path} that have both, each pair once, in order, with the doc_id of their path."""
    both = F.filter(F.transform(F.coalesce(raw, F.expr("cast(array() as array<struct<reference_id:string,file_path:string>>)")),
                                lambda r: F.struct(F.trim(F.coalesce(r["reference_id"], F.lit(""))).alias("reference_id"), F.trim(F.coalesce(r["file_path"], F.lit(""))).alias("file_path"))),
                    lambda r: (r["reference_id"] != "") & (r["file_path"] != ""))
    return F.transform(F.array_distinct(both), lambda r: F.struct(r["reference_id"].alias("reference_id"), r["file_path"].alias("file_path"), F.get(document_ids(r["file_path"]), F.lit(0)).alias("doc_id")))


def expanded_references(primary: Column, entities: Column) -> Column:
    """``primary`` and, numbered on from its largest numeric id, the documents that retrieved index nodes
    {entity_name, description} name and it lacks; each document once."""
    described = F.filter(F.coalesce(entities, F.expr("cast(array() as array<struct<entity_name:string,description:string>>)")), lambda e: F.coalesce(e["entity_name"], F.lit("")).rlike(INDEX_NAME))
    found = F.array_distinct(F.flatten(F.transform(described, lambda e: document_ids(e["description"]))))
    numbers = F.transform(F.filter(primary, lambda r: r["reference_id"].rlike("^[0-9]+$")), lambda r: r["reference_id"].cast("int"))
    last = F.coalesce(F.array_max(numbers), F.lit(0))
    extra = F.transform(found, lambda d, i: F.struct((last + 1 + i).cast("string").alias("reference_id"), F.concat(F.lit("/store/"), d, F.lit("/content.md")).alias("file_path"), d.alias("doc_id")))
    known = F.transform(primary, lambda r: r["doc_id"])
    return F.concat(primary, F.filter(extra, lambda r: ~F.coalesce(F.exists(known, lambda d: d == r["doc_id"]), F.lit(False))))


def with_references(answer: Column, refs: Column) -> Column:
    """The answer with whatever follows its heading 'References' replaced by one line a reference; without references
    the block goes. Applying it again changes nothing."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), REFERENCES_BLOCK, ""), r"\s+\z", "")
    lines = F.transform(refs, lambda r: F.concat(F.lit("- ["), r["reference_id"], F.lit("] "), F.coalesce(F.concat(F.lit("/store/"), r["doc_id"], F.lit("/content.md")), r["file_path"])))
    return F.when(F.size(refs) == 0, body).otherwise(F.concat(body, F.lit("\n\n### References\n\n"), F.array_join(lines, "\n")))


def trace_questions(stages: dict[str, tuple[Index, DataFrame]], questions: DataFrame, score: Column, expected: DataFrame, names: DataFrame, top_k: int = 30, rerank_top_k: int = 20,
                    reranked: str = "chunks_vdb") -> DataFrame:
    """(stage, question, prefix, seen): which expected documents the ``top_k`` hits of each vector stage (an index and
    its records vec_id, document_ids, file_path, full_doc_id) hold, and then the best ``rerank_top_k`` of the stage
    ``reranked`` by ``score``, the relevance of a hit as the reranker gave it, over its columns, question_id and rank."""
    hits = {s: kept(search(index, questions, top_k).join(records, "vec_id")) for s, (index, records) in stages.items()}
    hits["rerank"] = rerank(hits[reranked].withColumn("idx", F.col("rank")).drop("score", "rank"), score, "question_id", rerank_top_k)
    documents = {s: h.select(F.col("question_id").alias("question"), F.explode(hit_documents(F.col("document_ids"), F.col("file_path"), F.col("full_doc_id"))).alias("document_id")).distinct() for s, h in hits.items()}
    return trace(documents, expected, names)
