import random
import re
from collections import defaultdict

import pytest

from factloom.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    got, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        share = {s: left * w[s] / total for s in free}
        left = 0.0
        for s in share:
            got[s] += share[s]
            if got[s] >= 2 * sizes[s]:
                left += got[s] - 2 * sizes[s]
                got[s] = 2.0 * sizes[s]
                free.discard(s)
    return got


def test_targets_copies_and_reruns(spark):
    rng = random.Random(4)
    rows = [(i, None if rng.random() < 0.02 else " ".join("w" * rng.randint(1, 5) for _ in range(int(rng.paretovariate(1)) % 400)), s)
            for i, s in enumerate(rng.choices(["b", "a", "é", None, "", "zz"], [30, 5, 5, 3, 2, 1], k=3000))]
    rows += [(7, "same text", "a")] * 50 + [(None, "no id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["__size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r["__copies"] <= 2
        sizes[r.source] += r["__size"]
        taken[r.source] += r["__size"] * r["__copies"]
    want = brute_targets(sizes)
    for r in got:
        assert r["__target"] == pytest.approx(want[r.source]) and r["__source_size"] == sizes[r.source]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.05 * t + 800
    again = mixing.mix(docs.repartition(7)).select("doc_id", "__copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(docs).select("doc_id", "__copies").collect())
    assert mixing.mixed_documents(docs).count() == sum(r["__copies"] for r in got)


def test_empty_and_clashing_columns(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    one = spark.createDataFrame([(1, "", None, 3), (2, None, None, 4)], "doc_id long, text string, source string, size int")
    assert [r["__copies"] for r in mixing.mix(one).collect()] == [0, 0]
