import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import bpe, jaccard, kneser_ney, token_counts


def random_texts(seed, n, alphabet="ab c\n'sé7!  Th"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(n)] + ["a" * 3000, " " * 50, "it's " * 30, "é7!" * 40]


def test_tree_equals_the_library():
    whole = bpe.public_bpe()
    small = bpe.TreeBpe({b: i for i, b in whole.table.items()}, whole.pattern.pattern, leaf=7, piece_leaf=5, ids_leaf=3)
    for text in random_texts(1, 150) + ["word " * 3000, "\n\n  x" * 500]:
        for tree in (small, whole):
            ids = tree.encode(text)
            assert ids.tolist() == whole.whole.encode_ordinary(text)
            assert tree.decode(ids) == text.encode()


def test_encoded_documents(spark):
    rows = [(1, "it's a test", 5), (1, "it's a test", 5), (None, "é" * 2000, 6), (2, None, 7), (3, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = bpe.public_bpe().whole.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in bpe.encode_documents(docs).collect()), key=order) == sorted(want, key=order)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_flat_files_give_the_counts(spark, monkeypatch):
    texts = [None, "", *random_texts(2, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = bpe.public_bpe().whole
    for block in (3, 64, token_counts.BLOCK_TOKENS):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_documents(docs, block_tokens=block).collect()}
        assert got == {i: len(whole.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert token_counts.count_documents(docs.limit(0)).count() == 0


def test_files_of_lost_attempts_and_unfinished_documents(spark, tmp_path):
    ids = [5, 6, token_counts.END, token_counts.END, 7, 8, 9]
    np.array(ids, "<u2").tofile(tmp_path / "a.tokens")
    (tmp_path / "empty.tokens").touch()
    for block in (1, 2, 3, 100):
        got = token_counts.count_tokens(token_counts.token_files(spark, f"file://{tmp_path}"), block_tokens=block)
        assert sorted((r.file, r.ordinal, r.start, r.n_tokens) for r in got.collect()) == [("a.tokens", 0, 0, 2), ("a.tokens", 1, 3, 0), ("a.tokens", 2, 4, 3)]
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string").coalesce(1)
    listed = token_counts.write_token_files(docs, f"file://{tmp_path}/t")
    name = listed.first().file
    (tmp_path / "t" / "part-000000-77-lost.tokens").write_bytes(b"\1\0" * 9)
    files = token_counts.token_files(spark, f"file://{tmp_path}/t").join(listed.select("file").distinct(), "file", "left_semi")
    assert {r.file for r in token_counts.count_tokens(files).collect()} == {name}


def brute_model(train, order):
    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        tokens = ["<s>"] * (order - 1) + t.lower().split() + ["</s>"]
        for i in range(order - 1, len(tokens)):
            for k in range(1, order + 1):
                grams[k][tuple(tokens[i - k + 1 : i + 1])] += 1
    lefts = [set() for _ in range(order + 1)]
    for t in train:
        tokens = ["<s>"] * (order - 1) + t.lower().split() + ["</s>"]
        for i in range(order - 1, len(tokens)):
            for k in range(1, order):
                lefts[k].add(tuple(tokens[i - k : i + 1]))
    counts = [None] + [Counter(g[1:] for g in lefts[k]) for k in range(1, order)] + [grams[order]]
    return counts, len(grams[1])


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_a_plain_model(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choices(["a", "B", "cc", "d", "e", "f"], [9, 5, 4, 2, 1, 1], k=rng.randint(0, 15))) for _ in range(200)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t or "" for t in texts[:150]]
    model = kneser_ney.train(docs.where("doc_id < 150"), order, shards=5)
    counts, types = brute_model(train, order)
    assert model.types == types and model.tokens == sum(len(t.split()) + 1 for t in train)

    def p(history, w, k):
        if k == 0:
            return 1 / (types + 1)
        after = {g: c for g, c in counts[k].items() if g[:-1] == history}
        lower = p(history[1:], w, k - 1)
        if not after:
            return lower
        d = (0.0, *model.discounts[k - 1])
        total = sum(after.values())
        c = after.get((*history, w), 0)
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in after.values()) * lower) / total

    got = {r.doc_id: r for r in kneser_ney.score(docs, model).collect()}
    for i in range(140, 201):
        tokens = ["<s>"] * (order - 1) + (texts[i] or "").lower().split() + ["</s>"]
        want = sum(math.log10(p(tuple(tokens[j - order + 1 : j]), tokens[j], order)) for j in range(order - 1, len(tokens)))
        assert got[i].score == pytest.approx(want, abs=1e-6)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    texts = [None, "", " \t", "one", "ONE"]
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(["x", "yy", "zzz"])
        texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert np.unique([c for _, c in got.values()]).size == jaccard.one_of_each(docs).count()


def test_corpus_scores(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(kneser_ney, "SMALL", 1)
    import zlib

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["a", "B", "cc", "d"], k=rng.randint(0, 12))), 1.5) for i in range(60)] + [(7, None, 0.0), (None, "a a", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, t, _ in rows if not held(i) for w in [*(t or "").lower().split(), "</s>"])
    total = sum(count.values())
    got = kneser_ney.score_corpus(docs).collect()
    want = []
    for i, t, _ in rows:
        tokens = [*(t or "").lower().split(), "</s>"]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in tokens)
        want.append((str(i), held(i), len(tokens), sum(count[w] > 0 for w in tokens), total, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    none = kneser_ney.score_corpus(docs.limit(0))
    assert none.count() == 0
    untrained = kneser_ney.score(docs, kneser_ney.train(docs.limit(0), 3))
    assert {r.n_known for r in untrained.collect()} == {0}


def test_many_words_after_one_and_words_made_alike_are_told_apart(spark):
    n = 50_000
    morse = "a"
    while len(morse) < 4096:
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    # only id 19 is held out
    rows = [(i, " ".join(f"the w{i * n + k}" for k in range(n))) for i in (0, 1, 2, 4)] + [(12, morse), (19, other)]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    count = Counter(w for i, t in rows if not held[i] for w in [*t.split(), None])
    total, types = count.total(), len(count)
    got = {r.doc_id: r for r in kneser_ney.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, _ in rows if held[i]] == [19]
    for i, t in rows:
        tokens = [*t.split(), None]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(count[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(base, rel=1e-12)
