from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import jaccard, mixing, quality

WORDS = " ".join(f"w{i}" for i in range(40))


def test_near_copies_without_an_id_go(spark):
    rows = [(1, WORDS, 0), (None, WORDS + " more", 1), (None, " ".join(f"x{i}" for i in range(30)), 2), (None, " ".join(f"y{i}" for i in range(30)), 3),
            (None, "lone", 4), (None, None, 5), (None, "", 6), (None, "", 7), (9, "z " * 3, 8)]
    docs = spark.createDataFrame([(i, t, k, "c") for i, t, k in rows], "doc_id long, text string, n int, key string")
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.n for r in got.collect()) == [0, 2, 3, 4, 5, 6, 7, 8]


def test_two_texts_of_one_id_and_repeated_rows(spark):
    other = " ".join(f"x{i}" for i in range(40))
    rows = [(5, WORDS, 0), (5, other, 1), (6, WORDS + " more", 2), (7, other + " more", 3), (8, "p q r", 4), (8, "p q r", 5), (8, "s t u", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect())
    assert got == {(5, WORDS): 1, (5, other): 1, (8, "p q r"): 1, (8, "s t u"): 1}
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_quality_with_clashing_names_nulls_and_several_labels(spark):
    text = lambda i: " ".join(f"w{(i * 7 + k) % 50}" for k in range(30))
    rows = [(i, text(i), "en" if i % 3 else None, i, 1.0, "t", True, "a", "b") for i in range(120)] + [(None, text(3), "en", 0, 0.0, "t", False, "a", "b"), (500, None, None, 1, 0.0, "t", False, "a", "b")]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, log_ppl double, threshold string, keep boolean, __lang string, score string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(0, 0, 0), (1, 1, 1), (2, None, None), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    train, held = quality.trusted_ids(docs, labels)
    ids = sorted(r.doc_id for r in train.union(held).collect())
    assert ids == [i for i in range(60) if i not in (0, 1)]
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "text", "lang", "__lang", "score", *quality.ADDED]
    assert got.count() == len(rows) and {r.score for r in got.collect()} == {"b"}
    assert {r.n_tokens for r in got.where("doc_id = 4").collect()} == {31}
    good = quality.kept(docs, labels)
    assert good.columns == docs.columns and good.where("doc_id = 500").count() == 0
    assert good.where("doc_id = 4").head().n_tokens == 4 and good.count() >= 100
    # without any trusted text everything with words is kept
    assert quality.kept(docs, labels.limit(0)).count() == len(rows) - 1
    assert quality.kept(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("kind", ["string", "long", "double"])
def test_any_ids_are_mixed(spark, kind):
    rows = [(str(i), f"s{i % 2}", "w " * (i % 9)) for i in range(300)] + [(None, "s0", "w w")]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string")
    docs = docs.withColumn("doc_id", F.concat(F.lit("d-"), "doc_id") if kind == "string" else F.col("doc_id").cast(kind))
    got = mixing.mix(docs)
    taken = {r["__source_size"]: (r["t"], r["__target"]) for r in got.groupBy("__source_size", "__target").agg(F.sum(F.col("__copies") * F.col("__size")).alias("t")).collect()}
    assert got.count() == len(rows) and all(abs(t - goal) <= 20 for t, goal in taken.values())
