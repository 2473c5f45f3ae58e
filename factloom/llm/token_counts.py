"""Token counts of documents in flat token files that have no index, by a scan for end-of-document identifiers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END = 50256
BLOCK_TOKENS = 1 << 21


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one flat file of 16-bit ids a partition, each document followed by END, and return (file, ordinal, id)
    of the documents, written beside them. A null text is a document without tokens.

    Every attempt of a task writes a file of its own name and says so in its rows; Spark commits the rows of one attempt,
    and files that no row names are no part of the result, so lost or repeated tasks change nothing.
    """
    folder_at = folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import public_bpe

        encode, ordinal, task = public_bpe(tokenizer).whole.encode_to_numpy, 0, TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.tokens"
        fs, path = common.filesystem(f"{folder_at}/{name}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out:
            for batch in batches:
                for text in batch.column(1):
                    ids = np.append(encode(text.as_py() or ""), END)
                    if ids.max() > 0xFFFF:
                        raise ValueError("ids beyond 16 bits")
                    out.write(ids.astype("<u2").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], ["file", "ordinal", id_col])
                ordinal += n

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"file string, ordinal long, `{id_col}` {kind}")
    rows.write.parquet(f"{folder}/documents")
    return docs.sparkSession.read.schema(rows.schema).parquet(f"{folder}/documents")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, uri, n) of the token files of a folder; n is the number of tokens."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("path").alias("uri"), (F.col("length") / 2).cast("long").alias("n"))


def count_tokens(files: DataFrame, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens) of each document of the flat files (file, uri, n), its END not counted.

    Files are cut into blocks without regard to documents; each block is searched in one vector comparison, and a
    prefix scan over the blocks of a file gives each block the separators and the last separator before it. Tokens
    after the last separator are a last document without end; an empty file has none.
    """
    size = F.lit(block_tokens)
    blocks = files.where("n > 0").select("file", "uri", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))).alias("block"))
    blocks = blocks.select("file", "uri", "block", (F.col("block") * size).alias("first"), F.least(size, F.col("n") - F.col("block") * size).alias("length"), "n")
    blocks = blocks.repartition(common.shards(files.sparkSession), "file", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = common.filesystem(r["uri"])
                with fs.open_input_file(path) as f:
                    f.seek(2 * r["first"])
                    ids = np.frombuffer(f.read(2 * r["length"]), "<u2")
                ends = np.flatnonzero(ids == end).astype(np.int64) + r["first"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]]), pa.array([r["block"]], pa.int64()), pa.array([r["n"]], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file", "block", "n", "ends"])

    found = blocks.mapInArrow(scan, "file string, block long, n long, ends array<long>")
    found = common.written(found, "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("file", "block", "n", F.size("ends").alias("k"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    carried = sums.select(
        "file", "block",
        F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"),
        F.sum("k").over(Window.partitionBy("file")).alias("all_ends"),
        F.coalesce(F.max("last").over(Window.partitionBy("file")), F.lit(-1)).alias("final"))
    rows = found.join(carried, ["file", "block"])
    starts = F.concat(F.array(F.col("previous") + 1), F.transform(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda e: e + 1))
    whole = rows.where(F.size("ends") > 0).select("file", "base", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("i", "d"))
    whole = whole.select("file", (F.col("base") + F.col("i")).alias("ordinal"), F.col("d.s").alias("start"), (F.col("d.e") - F.col("d.s")).alias("n_tokens"))
    rest = rows.where((F.col("block") == 0) & (F.col("final") < F.col("n") - 1)).select("file", F.col("all_ends").alias("ordinal"), (F.col("final") + 1).alias("start"), (F.col("n") - 1 - F.col("final")).alias("n_tokens"))
    return whole.unionByName(rest)


def count_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, n_tokens) of each row of ``docs``, through flat token files in the shared folder. Null ids stay null, null
    texts have no tokens, repeated rows are counted each, an empty table gives an empty result, and other columns are
    not looked at."""
    spark = docs.sparkSession
    folder = common.fresh_path(spark, "tokens")
    listed = write_token_files(docs, folder, tokenizer, id_col)
    files = token_files(spark, folder).join(listed.select("file").distinct(), "file", "left_semi")
    return listed.join(count_tokens(files, block_tokens=block_tokens), ["file", "ordinal"]).select(id_col, "n_tokens")
