"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, held against quantiles of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, kneser_ney

#: Values from which a language has a threshold of its own; with fewer it is never stricter than that of all.
LEAST = 200
#: Trusted ids are broadcast up to this number and joined by a shuffle beyond it.
BROADCAST_IDS = 1_000_000
#: Documents trained on in a task, about a block of the model's counts where they have 500 words.
A_TASK = 4096
ORDER = 3
QUANTILE = 0.985
SEED = 17


def _share(counts: list[int], sample: int) -> int:
    """The most that each may have so that no more than ``sample`` are taken in all."""
    left, counts = sample, sorted(counts)
    for i, c in enumerate(counts):
        if c * (len(counts) - i) > left:
            return left // (len(counts) - i)
        left -= c
    return sample


def trusted_ids(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ids of the trusted documents to train on, and of all other trusted ones, for thresholds.

    Trusted: labelled quality 1 and not toxic, with no other label. About half of each language's, by a seeded hash,
    are trained on. With ``sample`` no more than so many are: each language gives those of smallest hash, as many as an
    even share has.
    """
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0 and doc_id is not null")
    ids = trusted.select("doc_id").join(docs.groupBy("doc_id").agg(F.min("lang").alias("lang")), "doc_id")
    ids = common.written(ids.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(SEED)).alias("h")), "trusted")
    able = ids.where("pmod(h, 2) = 1")
    if sample is None:
        return able.select("doc_id"), ids.where("pmod(h, 2) = 0").select("doc_id")
    counts = able.groupBy("lang").count()
    share = _share([r["count"] for r in counts.collect()], sample)  # a number a language
    # hashes far above the share-th smallest needn't be sorted
    low = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * F.col("count") < F.lit(2 * share + 100)
    near = able.join(F.broadcast(counts.withColumnRenamed("lang", "__lang")), F.col("lang").eqNullSafe(F.col("__lang"))).where(low)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    train = common.written(ranked.where(F.col("rank") <= share).select("doc_id"), "train-ids")
    return train, common.written(ids.join(F.broadcast(train), "doc_id", "left_anti").select("doc_id"), "held-out-ids")


def gathered(train: DataFrame, n: int) -> DataFrame:
    """``n`` documents to train on in fewer tasks, as many as cores at least: they are a small part of what each task
    reads, and a block sends each shard the words of its n-grams anew, so small blocks send most words."""
    return train.coalesce(max(train.sparkSession.sparkContext.defaultParallelism, -(-n // A_TASK)))


def with_perplexity(docs: DataFrame, model: kneser_ney.Model) -> DataFrame:
    """``docs`` with n_tokens and log_ppl, the mean negative log10 probability of a token; nothing is shuffled."""
    scored = kneser_ney.score(docs, model, extra=tuple(c for c in docs.columns if c != "doc_id"))
    return scored.select(*docs.columns, "n_tokens", (-F.col("score") / F.col("n_tokens")).alias("log_ppl"))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, most): the quantile of log_ppl in each language, that of all rows at least where it has fewer than
    ``LEAST``, and with lang null that of all rows."""
    rows = common.written(scored.select("lang", F.round("log_ppl", 4).alias("v")), "held-out")
    rest = rows.agg(F.percentile("v", F.lit(quantile)).alias("rest"))
    each = rows.where("lang is not null").groupBy("lang").agg(F.percentile("v", F.lit(quantile)).alias("own"), F.count("v").alias("n"))
    each = each.crossJoin(F.broadcast(rest)).select("lang", F.when(F.col("n") >= LEAST, F.col("own")).otherwise(F.greatest("own", "rest")).alias("most"))
    return each.unionByName(rest.select(F.lit(None).cast("string").alias("lang"), F.col("rest").alias("most")))


#: What ``classify`` adds.
ADDED = ("n_tokens", "log_ppl", "threshold", "keep")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, sample: int | None = None, order: int = ORDER) -> DataFrame:
    """``docs`` with n_tokens, log_ppl, threshold and keep; columns of these names are replaced.

    A document is kept while its perplexity is within its language's threshold; one without words is not. Null or
    unseen languages take the threshold of all; without any trusted text everything with words is kept. Other columns
    pass through whatever their names, repeated rows are classified alike, null texts count as empty. Of several labels
    of a document each has to call it good; rows without an id are never trusted.
    """
    docs = docs.select(*(c for c in docs.columns if c not in ADDED))
    train, held_out = trusted_ids(docs, labels, sample)
    small = lambda ids, n: F.broadcast(ids) if n <= BROADCAST_IDS else ids
    n = train.count()
    # a model of few documents has few shards, as each is joined to every block of documents in turn
    texts = docs.select("doc_id", "text").join(small(train, n), "doc_id", "left_semi")
    model = kneser_ney.train(gathered(texts, n), order, shards=8 if sample else None)
    rest = docs.select("doc_id", "text", "lang").join(small(held_out, held_out.count()), "doc_id", "left_semi")
    limits = common.written(thresholds(with_perplexity(rest, model), quantile), "thresholds")  # one row a language
    own = F.broadcast(limits.where("lang is not null").select(F.col("lang").alias("__lang"), F.col("most").alias("__own")))
    rest = limits.where("lang is null").agg(F.max("most").alias("__rest"))
    # other columns travel as one, so that their names can't clash with those made on the way
    others = [c for c in docs.columns if c not in ("doc_id", "text", "lang")]
    rows = docs.select("doc_id", "text", "lang", *([F.struct(*others).alias("__others")] if others else []))
    rows = with_perplexity(rows, model).join(own, F.col("lang") == F.col("__lang"), "left").crossJoin(F.broadcast(rest))
    limit = F.coalesce("__own", "__rest")
    keep = (F.col("n_tokens") > 1) & F.coalesce(F.col("log_ppl") <= limit, F.lit(True))
    named = [F.col("__others")[c].alias(c) if c in others else F.col(c) for c in docs.columns]
    return rows.select(*named, "n_tokens", "log_ppl", limit.alias("threshold"), keep.alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns, also those of the names that it adds."""
    rows = docs.select("doc_id", "text", "lang", F.struct(*(c for c in docs.columns if c not in ("doc_id", "text", "lang"))).alias("__row")) if set(docs.columns) - {"doc_id", "text", "lang"} else docs
    good = classify(rows, labels, **how).where("keep")
    return good.select(*(F.col("__row")[c].alias(c) if c not in ("doc_id", "text", "lang") else F.col(c) for c in docs.columns))
