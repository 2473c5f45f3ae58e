import random

import numpy as np
import pytest

from factloom.llm import quality


def test_thresholds_of_rare_languages_come_from_all_their_trusted_texts(spark):
    rng = random.Random(4)
    words = {l: [f"{l}{i}" for i in range(40)] for l in ("en", "sw", "xx")}
    langs = ["en"] * 3000 + ["sw"] * 500 + ["xx"] * 6
    rows = [(i, " ".join(rng.choices(words[l], range(40, 0, -1), k=rng.randint(5, 40))), l) for i, l in enumerate(langs)]
    docs = spark.createDataFrame([*rows, (9000, " ".join(f"q{i * i}" for i in range(30)), "sw")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(rows))], "doc_id long, quality int, toxic int")
    train, held = (x.join(docs, "doc_id").select("doc_id", "lang").collect() for x in quality.trusted_ids(docs, labels, 40))
    assert len(train) <= 40 and sorted(r.doc_id for r in train + held) == list(range(len(rows)))
    assert sum(r.lang == "sw" for r in train) >= 10
    got = {r.doc_id: r for r in quality.classify(docs, labels, sample=40).collect()}
    ids = {l: [r.doc_id for r in held if r.lang == l] for l in words}
    for l in ("en", "sw"):
        want = np.quantile([round(got[i].log_ppl, 4) for i in ids[l]], quality.QUANTILE)
        assert got[ids[l][0]].threshold == pytest.approx(want, abs=1e-9)
        assert np.mean([got[i].keep for i in ids[l]]) >= 0.98
    pooled = np.quantile([round(got[r.doc_id].log_ppl, 4) for r in held], quality.QUANTILE)
    assert got[3500].threshold >= pooled - 1e-9 and not got[9000].keep


def test_half_of_all_trusted_texts_is_trained_on_and_the_rest_sets_thresholds(spark):
    n = 20_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id % 7) as text", "if(id % 4 = 0, 'en', 'sw') as lang")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    train, held = (x.agg({"doc_id": "count"}).first()[0] for x in quality.trusted_ids(docs, labels))
    assert train + held == n and abs(train - n / 2) < n / 50


def test_few_trained_documents_are_counted_in_few_blocks_with_the_same_results(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(60)], k=20)), "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id % 3 = 0").selectExpr("doc_id", "1 as quality", "0 as toxic")
    parts = docs.repartition(40)
    cores = spark.sparkContext.defaultParallelism
    assert quality.gathered(parts, 150).rdd.getNumPartitions() == cores
    assert quality.gathered(parts, 20 * quality.A_TASK + 1).rdd.getNumPartitions() == 21
    of = lambda d: {r.doc_id: (r.n_tokens, round(r.log_ppl, 9), round(r.threshold, 9), r.keep) for r in quality.classify(d, labels).collect()}
    assert of(parts) == of(docs.coalesce(1)) and len(of(parts)) == 900
