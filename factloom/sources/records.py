"""Readers of record stores: JSON lines with the last line of an id winning, and documents in folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType, key: str = "id") -> DataFrame:
    """Records of JSON lines; blank and malformed lines are skipped, and the last line of an id wins, by file and then
    by place in it."""
    lines = StructType([*schema.fields, StructField("__bad", StringType())])
    rows = spark.read.schema(lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    rows = rows.where(F.col("__bad").isNull() & F.col(key).isNotNull())
    last = Window.partitionBy(key).orderBy(F.desc("__file"), F.desc("__block"), F.desc("__line"))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").select(*schema.fieldNames())


def refused(rows: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """The ids that can't be appended, (key, reason): those the store has and those that occur again in ``rows``."""
    there = rows.select(key).distinct().join(stored.select(key).distinct(), key, "left_semi").withColumn("reason", F.lit("stored"))
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("repeated").alias("reason"))
    return there.unionByName(again.join(there.select(key), key, "left_anti"))


def append_new(spark: SparkSession, rows: DataFrame, path: str, schema: StructType, key: str = "id") -> DataFrame:
    """The rows whose id the store at ``path`` doesn't have; these can be appended."""
    return rows.join(read_jsonl(spark, path, schema, key).select(key), key, "left_anti")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file {"cases": [...]}."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, content_md, metadata) of each folder that has both; temporary folders are left out."""
    content = spark.read.text(f"{root}/*/content.md", wholetext=True).select(F.col("value").alias("content_md"), F.col("_metadata.file_path").alias("p"))
    about = spark.read.text(f"{root}/*/metadata.json", wholetext=True).select(F.col("value").alias("metadata"), F.col("_metadata.file_path").alias("p"))
    folder = F.regexp_extract("p", r"/([^/]+)/[^/]+$", 1)
    rows = content.select(folder.alias("document_id"), "content_md").join(about.select(folder.alias("document_id"), "metadata"), "document_id")
    return rows.where(~F.col("document_id").startswith(".tmp-"))


def read_folder(spark: SparkSession, folder: str, names_only: bool = False) -> DataFrame:
    """(path, is_file, hash, size) of the files right in a folder, in order of their paths, whatever their type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    rows = files.select("path", F.lit(True).alias("is_file"), *([] if names_only else [F.sha2("content", 256).alias("hash")]), F.col("length").alias("size"))
    return rows.orderBy("path")


def document_maps(store: DataFrame) -> DataFrame:
    """(document_id, original_filename, document_date, doc_context, extraction_quality) from the metadata of a store, for
    looking up names and dates; documents whose metadata don't parse or have no id are left out."""
    about = F.try_parse_json("metadata")
    field = lambda k, t="string": F.try_variant_get(about, f"$.{k}", t).alias(k)
    rows = store.select(field("document_id"), field("original_filename"), field("document_date"), field("doc_context", "array<string>"), field("extraction_quality"))
    return rows.where(F.coalesce("document_id", F.lit("")) != "")
