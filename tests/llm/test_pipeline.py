import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from factloom.llm import bpe, mixing, quality

from .test_suffixes import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def fixture(spark, folder):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    vocabulary = [word() for _ in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for i in range(150):
        w = rng.choices(vocabulary, k=rng.randint(20, 60))
        if i % 10 == 0:
            w[5:5] = passage.split()
        rows.append([i, " ".join(w), "en", f"s{i % 4}", 0])
    rows += [[200 + i, rows[i][1] + " more", "en", "s1", 0] for i in range(0, 40, 4)] + [[300 + i, rows[i][1], "en", None, 0] for i in range(1, 20, 6)]
    rows += [[400, " ".join(f"q{i * i}" for i in range(50)), "en", "s0", 0], [401, None, "en", "s0", 0], [402, "", "fr", "s1", 0]]
    spark.createDataFrame([tuple(r) for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def one_of_each(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if find(i) == i}


def test_each_stage_does_its_work_on_the_one_before(spark, tmp_path):
    folder = str(tmp_path)
    fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["quality", "near copies", "repeats", "mix", "tokens"]
    kept = named["quality"](spark, docs, folder).cache()
    verdict = {r.doc_id: r.keep for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k} and kept.columns == docs.columns
    assert not verdict[400] and not verdict[401] and not verdict[402] and sum(verdict[i] for i in range(150)) >= 140
    single = named["near copies"](spark, kept, folder).cache()
    assert {r.doc_id for r in single.collect()} == one_of_each(kept.collect()) and single.columns == docs.columns
    rows = single.orderBy("doc_id").collect()
    cut = named["repeats"](spark, single, folder).cache()
    want = {r.doc_id: h for r, (_, _, _, h) in zip(rows, brute([r.text for r in rows], 200)) if h != hashlib.sha256(b"").hexdigest()}
    got = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in cut.collect()}
    assert got == want and want != {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in rows}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    mixed = named["mix"](spark, cut, folder).cache()
    copies = {r.doc_id: r.n for r in mixing.mix(cut).select("doc_id", F.col("__copies").alias("n")).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    last = Counter(tuple(r) for r in named["tokens"](spark, mixed, folder).collect())
    encode = bpe.public_bpe().whole.encode_ordinary
    assert Counter((i, n) for i, n, *_ in last.elements()) == Counter((r.doc_id, len(encode(r.text))) for r in mixed.collect())
    assert last == Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
