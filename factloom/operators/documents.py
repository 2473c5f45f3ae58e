"""Documents: states of intake, versions, doubts, text windows, overlays and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEAD, MOST = 3000, 6000
TELLING = 1500
#: The file types that can be taken in, the tags of documents and, by tag, the types to look for.
SUFFIXES = (".pdf", ".docx", ".pptx", ".xlsx", ".html", ".htm", ".md", ".markdown", ".csv", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp", ".xml", ".adoc", ".asciidoc")
MIME = {".pdf": "application/pdf", ".html": "text/html", ".htm": "text/html", ".md": "text/markdown", ".markdown": "text/markdown", ".csv": "text/csv", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
        ".tiff": "image/tiff", ".tif": "image/tiff", ".bmp": "image/bmp", ".webp": "image/webp", ".xml": "text/xml", ".txt": "text/plain",
        ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
TAGS = ("work", "healthcare", "finance", "property", "vehicle", "identity", "family", "legal", "education", "travel", "food", "administrative", "other")
FOCUS = {
    "work": ("employer", "role", "skill", "organization", "person", "amount", "date"),
    "healthcare": ("medication", "diagnosis", "procedure", "medical_provider", "body_part", "person", "organization", "date"),
    "finance": ("account", "amount", "organization", "person", "date"), "property": ("property", "location", "amount", "person", "date"),
    "vehicle": ("vehicle", "identifier", "amount", "person", "date"), "identity": ("identifier", "person", "date", "location"),
    "family": ("person", "event", "date"), "legal": ("organization", "person", "location", "amount", "date", "document"),
    "education": ("role", "skill", "organization", "date", "person"), "travel": ("trip", "accommodation", "location", "date", "amount"),
    "food": ("ingredient", "dish", "nutrient", "cooking_technique"), "administrative": ("organization", "person", "date", "identifier"),
}
MOST_TAGS, MOST_FOCUS = 3, 10
_STRINGS = "array<string>"


def suffix(path: Column) -> Column:
    """The suffix of a file's name in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]+)$", 1))


def supported(path: Column) -> Column:
    return suffix(path).isin(list(SUFFIXES))


def mime_type(path: Column, guessed: Column | None = None, confidence: Column | None = None) -> Column:
    """What was sniffed with a confidence of 0.5 or more, else what the suffix stands for, else octet-stream."""
    default = F.lit("application/octet-stream")
    known = F.coalesce(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))[suffix(path)], default)
    return known if guessed is None else F.when((guessed != default) & (confidence >= 0.5), guessed).otherwise(known)


def ingest_states(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, status, document_id) of each of ``files`` (path, is_file, hash, converted) against ``stored`` (document_id,
    hash, path): what is no file fails, a suffix or conversion that isn't supported, a known content or one of an earlier
    path of the batch is a duplicate of its document, a known path with new content is updated, the rest is ingested.

    document_id is that of the stored document; null where one is new.
    """
    able = F.coalesce("is_file", F.lit(False)) & supported(F.col("path"))
    rows = files.select("path", "is_file", "hash", F.coalesce("converted", F.lit(True)).alias("converted"), able.alias("able"))
    # only files that are taken in make later ones of the same content duplicates
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("hash", F.col("able") & F.col("converted")).orderBy("path")))
    by_hash = stored.groupBy("hash").agg(F.min("document_id").alias("same_hash"))
    by_path = stored.groupBy("path").agg(F.min("document_id").alias("same_path"))
    rows = rows.join(by_hash, "hash", "left").join(by_path, "path", "left")
    repeated = F.col("same_hash").isNotNull() | (F.col("converted") & (F.col("n") > 1) & F.col("hash").isNotNull())
    status = F.when(~F.coalesce("is_file", F.lit(False)), "failed").when(~F.col("able"), "unsupported").when(repeated, "duplicate")
    status = status.when(~F.col("converted"), "unsupported").when(F.col("same_path").isNotNull(), "updated").otherwise("ingested")
    rows = rows.withColumn("status", status)
    return rows.select("path", "status", F.when(F.col("status") == "duplicate", F.col("same_hash")).when(F.col("status") == "updated", F.col("same_path")).alias("document_id"))


def duplicates(docs: DataFrame) -> DataFrame:
    """(hash, first, copies) of each content."""
    return docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))


def versions(docs: DataFrame, key: str, order: str) -> DataFrame:
    """Version numbers of rows of one key, by ``order``; the last one is current."""
    w = Window.partitionBy(key)
    return docs.withColumn("version", F.row_number().over(w.orderBy(order))).withColumn("is_current", F.col("version") == F.count(F.lit(1)).over(w))


def retagged(metadata: DataFrame, tags: DataFrame) -> DataFrame:
    """``metadata`` with the doc_context that ``tags`` (document_id, tags) gives anew."""
    rows = metadata.join(tags.select("document_id", F.col("tags").alias("__tags")), "document_id", "left")
    return rows.withColumn("doc_context", F.coalesce("__tags", "doc_context")).drop("__tags").select(*metadata.columns)


def head_and_tail(text: Column) -> Column:
    """The whole text up to 6000 characters, else its first and last 3000 with a line break between."""
    return F.when(F.length(text) <= MOST, text).otherwise(F.concat(F.substring(text, 1, HEAD), F.lit("\n"), F.right(text, F.lit(HEAD))))


def telling_lines(text: Column, most: int = TELLING) -> Column:
    """The trimmed lines that are neither empty nor more than half table drawing, up to ``most`` characters in all with
    their breaks; the line that goes beyond is cut."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", -1), lambda x: F.regexp_replace(x, T.BLANKS, ""))
    kept = F.filter(lines, lambda x: (x != "") & ~(F.length(F.regexp_replace(x, r"[^|\-: ]", "")) > F.length(x) * F.lit(0.5)))
    # each line and its break take room; what is joined is what a plain cut leaves, but for a last break
    joined = F.substring(F.array_join(kept, "\n"), 1, most)
    return F.regexp_replace(joined, r"\n\z", "")


def overlaid(text: Column, replacements: Column) -> Column:
    """Literal replacements {find, replace} in order; a null or empty find is skipped, a null replacement is empty."""
    return F.aggregate(F.coalesce(replacements, F.expr("cast(array() as array<struct<find:string,replace:string>>)")), text,
                       lambda t, r: F.when(F.coalesce(r["find"], F.lit("")) == "", t).otherwise(F.replace(t, r["find"], F.coalesce(r["replace"], F.lit("")))))


def with_headers(text: Column, day: Column, focus: Column) -> Column:
    """The text with its date and then the types to look for before it, each where it is given, and an empty line after
    each."""
    dated = F.when(F.coalesce(day.cast("string"), F.lit("")) != "", F.concat(F.lit("[DOCUMENT DATE: "), day.cast("string"), F.lit("]\n\n"), text)).otherwise(text)
    return F.when(F.size(focus) > 0, F.concat(F.lit("[EXTRACTION FOCUS: prioritize entities of these types: "), F.array_join(focus, ", "), F.lit(".]\n\n"), dated)).otherwise(dated)


def focus_types(tags: Column) -> Column:
    """The types to look for in documents with these tags, in order of first mention, ten at most."""
    known = F.create_map(*(x for t, types in FOCUS.items() for x in (F.lit(t), F.array(*map(F.lit, types)))))
    none = F.array().cast(_STRINGS)
    return F.slice(F.array_distinct(F.flatten(F.transform(F.coalesce(tags, none), lambda t: F.coalesce(known[t], none)))), 1, MOST_FOCUS)


def union_of_types(base: Column, more: Column) -> Column:
    """``base`` and, lower-cased, those of ``more`` that it lacks whatever their case, each once."""
    both = F.concat(base, F.transform(more, lambda x: F.lower(x)))
    return F.filter(both, lambda x, i: F.array_position(F.transform(both, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def classified(raw: Column) -> Column:
    """{tags, rationale} of a classifier's answer: fences and prose around its object go, unknown tags are dropped, three
    are kept, each once; 'other' where none is left."""
    bare = F.trim(F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), raw, F.lit("")))
    value = F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))
    an_object = F.schema_of_variant(value).startswith("OBJECT")
    listed = F.when(an_object, F.try_variant_get(value, "$.tags", "array<variant>"))
    texts = F.transform(F.filter(F.coalesce(listed, F.expr("cast(array() as array<variant>)")), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.lower(F.trim(F.variant_get(v, "$", "string"))))
    tags = F.slice(F.array_distinct(F.filter(texts, lambda t: t.isin(list(TAGS)))), 1, MOST_TAGS)
    said = F.when(an_object & (F.schema_of_variant(F.try_variant_get(value, "$.rationale", "variant")) == "STRING"), F.trim(F.try_variant_get(value, "$.rationale", "string")))
    reason = F.when(value.isNull(), "classifier response: invalid JSON").when(~an_object, "classifier response: not an object").otherwise(F.coalesce(said, F.lit("")))
    return F.struct(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("other"))).alias("tags"), reason.alias("rationale"))


def doubts(quality: Column, day: Column) -> Column:
    """Doubts {field, inferred_value, confidence, suggested_action, remedy} about a source: a missing date, and a
    degraded (with a remedy where the date is missing too) or empty extraction."""
    doubt = lambda f, v, c, a, r=F.lit(False): F.struct(F.lit(f).alias("field"), F.lit(v).cast("string").alias("inferred_value"), F.lit(c).alias("confidence"), F.lit(a).alias("suggested_action"), r.alias("remedy"))
    dated = F.when(day.isNull(), doubt("document_date", None, "low", "provide"))
    read = F.when(quality == "degraded", doubt("extraction_quality", "degraded", "medium", "review", day.isNull())).when(quality == "empty", doubt("extraction_quality", "empty", "high", "replace"))
    return F.array_compact(F.array(dated, read))


def format_doubt(path: Column) -> Column:
    """The doubt about a file whose suffix isn't supported."""
    return F.struct(F.lit("format").alias("field"), F.when(suffix(path) == "", ".").otherwise(suffix(path)).alias("inferred_value"), F.lit("high").alias("confidence"), F.lit("replace").alias("suggested_action"), F.lit(False).alias("remedy"))


def _texts(doc: Column) -> Column:
    """{parent, text} of the texts of a converted document, with nulls for what isn't there."""
    items = F.coalesce(F.try_variant_get(doc, "$.texts", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return F.transform(items, lambda v: F.struct(F.try_variant_get(v, "$.parent['$ref']", "string").alias("parent"), F.trim(F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))).alias("text")))


def extraction_quality(doc: Column) -> Column:
    """'rich' from three texts right under the body on, 'empty' without any text or anything in the body, else
    'degraded', of a converted document (variant)."""
    texts = F.filter(_texts(doc), lambda t: (t["text"] != "") & t["parent"].isNotNull())
    body = F.size(F.filter(texts, lambda t: t["parent"] == "#/body"))
    children = F.size(F.coalesce(F.try_variant_get(doc, "$.body.children", "array<variant>"), F.expr("cast(array() as array<variant>)")))
    return F.when(body >= 3, "rich").when((F.size(texts) == 0) | (children == 0), "empty").otherwise("degraded")


def fallback_markdown(doc: Column) -> Column:
    """A block '## Picture i' of the texts under each picture of a converted document (variant) that has any."""
    none = F.expr("cast(array() as array<variant>)")
    texts = _texts(doc)

    def found(picture: Column) -> Column:
        refs = F.transform(F.coalesce(F.try_variant_get(picture, "$.children", "array<variant>"), none), lambda c: F.regexp_extract(F.coalesce(F.try_variant_get(c, "$['$ref']", "string"), F.lit("")), r"^#/texts/(?:.*/)?(\d+)$", 1))
        return F.filter(F.transform(refs, lambda n: F.get(texts, F.coalesce(n.try_cast("int"), F.lit(-1)))["text"]), lambda t: F.coalesce(t, F.lit("")) != "")

    blocks = F.transform(F.coalesce(F.try_variant_get(doc, "$.pictures", "array<variant>"), none), lambda p, i: F.when(F.size(found(p)) > 0, F.concat(F.lit("## Picture "), (i + 1).cast("string"), F.lit("\n\n"), F.array_join(found(p), "\n\n"))))
    return F.array_join(F.array_compact(blocks), "\n\n")


def packed(docs: DataFrame) -> DataFrame:
    """(document_id, part): each document with a header, in order of ids, as the parts of one prompt over the corpus;
    they stay rows, so that no task holds the corpus."""
    name = F.coalesce(F.nullif("original_filename", F.lit("")), F.col("document_id"))
    header = F.concat(F.lit("\n\n=== /store/"), "document_id", F.lit("/content.md (filename: "), name, F.lit(") ===\n\n"))
    return docs.where(F.coalesce("document_id", F.lit("")) != "").select("document_id", F.concat(header, F.coalesce("content", F.lit(""))).alias("part")).orderBy("document_id")
