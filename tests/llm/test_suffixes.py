import hashlib
import random
from collections import Counter

import pytest

from factloom.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(rng, alphabet, n):
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 700))) for _ in range(6)]
    texts = [None, "", "short", "a" * 900, "ab" * 300, "é" * 250]
    for _ in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(rng.randint(1, 4))]
        texts.append("".join(p[rng.randint(0, 30) :] for p in parts))
    return texts + texts[-3:]


@pytest.mark.parametrize("seed,alphabet,length,many", [(1, "ab", 200, 16), (2, "abcdefgh é\n", 200, 2), (3, "abc ", 70, 1), (4, "ab", 30, 10**6)])
def test_equals_brute_force(spark, monkeypatch, seed, alphabet, length, many):
    monkeypatch.setattr(suffixes, "PIECE", 256)
    monkeypatch.setattr(suffixes, "BLOCK", 300)
    monkeypatch.setattr(suffixes, "MANY_IN_BLOCK", many)
    monkeypatch.setattr(suffixes, "MANY", 4 * many)
    monkeypatch.setattr(suffixes, "INDEX_CONTEXTS", 20)
    texts = corpus(random.Random(seed), alphabet, 30)
    texts += texts[6:16] + texts[6:9] * 3
    random.Random(seed).shuffle(texts)  # copies fall in the same and in other blocks
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    rows = suffixes.without_repeats(docs, length).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute(texts, length)


def test_empty_table_and_cleaned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(empty).count() == 0
    common = "x1 y2 " * 60
    docs = spark.createDataFrame([(1, "head " + common), (2, common + " tail"), (3, common), (4, common), (5, None)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in suffixes.cleaned(docs).collect()}
    assert set(kept) == {1, 2, 5} and "x1 y2 x1" not in kept[1] + kept[2]


def test_texts_without_an_id_and_ids_of_two_texts(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = word(260), word(260), word(300)
    rows = [(1, word(50) + a), (None, a + word(70)), (2, word(30) + b), (2, word(900) + b + word(5)), (None, word(400)), (3, word(20) + c), (None, c + word(10)), (3, word(600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in suffixes.without_repeats(docs).collect())
    assert got == sorted(brute([t for _, t in rows], 200))
    want = Counter((i, k[3]) for (i, _), k in zip(rows, brute([t for _, t in rows], 200)))
    assert Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in suffixes.cleaned(docs).collect()) == want
