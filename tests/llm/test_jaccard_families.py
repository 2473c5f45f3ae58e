"""Families of near copies about the threshold, held against all pairs."""

from __future__ import annotations

import random

import pytest

from factloom.llm import jaccard


def _brute(texts: dict[int, str], n_words: int, percent: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + n_words]) for k in range(max(1, len(w) - n_words + 1))}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rounds, frequent, bits", [(0, 4096, 64), (1, 4096, 64), (1, 20, 64), (0, 1, 64), (1, 4096, 12)])
def test_families_equal_brute_force(spark, monkeypatch, rounds, frequent, bits):
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng, texts = random.Random(5), {}
    for _ in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 90]))]
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randrange(1, 6)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(200)}"
            texts[len(texts)] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, 3, 80, bits=bits).collect()}
    assert got == _brute(texts, 3, 80)
    assert 4 < len(set(got.values())) < len(got)


def test_different_sets_of_one_fingerprint_are_told_by_the_second(spark):
    # with 3 bits nearly all 40 sets share a name; without the second fingerprint these would be at most 8 classes
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10))) for i in range(40)]
    rows += [(100 + i, t) for i, t in rows[:5]] + [(200, ""), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    info = jaccard.shingle_sets(docs, 2, name=jaccard.fingerprints(3))
    assert len(jaccard.shared_fingerprints(info)) > 4 and jaccard.shared_fingerprints(jaccard.shingle_sets(docs, 2)) == ()
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, 2, 80, bits=3).collect()}
    assert got == {i: i - 100 if 100 <= i < 200 else i for i, _ in rows}


def test_sets_without_an_id_link_and_bridge(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda a, b: " ".join([*(f"x{i}" for i in range(a)), *base[a : 60 - b], *(f"y{i}" for i in range(b))])
    # 1 and 2 are apart, and each is near the text between them, which has no id; 4 stands for two texts
    rows = [(1, near(5, 0)), (None, near(0, 0)), (2, near(0, 5)), (3, "all other words"), (4, "z " + near(0, 40)), (4, "v u t s r q p o n m"), (5, "v u t s r q p o n m l")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 4)]


def test_frequent_shingles_are_those_of_many_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 50)
    text = "concat_ws(' ', if(id % 3 = 0, 'one of these', 'no'), transform(sequence(1, 9000), k -> concat('w', id, 'x', k)))"
    info = jaccard.shingle_sets(spark.range(0, 300, 1, 1).selectExpr("id as doc_id", f"{text} as text"), 1, with_common=True).persist()
    assert len(jaccard.frequent_shingles(info, 300)) == 4
    assert len(jaccard.frequent_shingles(info.where("n < 0"), 0)) == 0
    assert info.count() == 300 and info.where("common is not null").count() == 3  # 2.7 M shingles in blocks of 2 ** 20
