import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from factloom.llm import filter_audit


def mask_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) << 2 | bool(re.search(r"[#$%&*|]", text)) << 3)


def plain(rows, labels):
    """Each order applied one filter after another."""
    rows = [(i, s or "", t or "") for i, s, t in rows]
    least, good, toxic = {}, set(), set()
    for i, _, t in rows:
        if i is not None and i < least.get(t, i + 1):
            least[t] = i
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    fails = [(i, s, mask_of(t) | (i is not None and i > least[t]) << 4) for i, s, t in rows]
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {s for _, s, _ in fails}:
            here, gone = [(i, m) for i, s, m in fails if s == part], set()
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                removed = [k for k, (_, m) in enumerate(here) if m & bit and k not in gone]
                redundant = sum(bool(m & bit) for k, (_, m) in enumerate(here) if k in gone)
                gone |= set(removed)
                ids = [here[k][0] for k in removed]
                out[part, "".join(order), step] = [len(here) - len(gone), len(removed), redundant, sum(m == bit for _, m in here), sum(i in good for i in ids), sum(i in toxic for i in ids)]
                shapley[part, f] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def table(spark):
    rnd = random.Random(4)
    texts = [None, "", " ", "ALL CAPS", "a $ sign", "same " * 80, "é" * 300, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)) + "|", "x" * 200_000, "x" * 200_000 + "y",
             "p" * 100 + " one", "p" * 100 + " two", "\t\n\x0b", "\xa0".join("ab" for _ in range(70))]
    texts += [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(40)) for _ in range(rnd.choice([3, 49, 50, 51, 90]))) for _ in range(40)]
    rows = [(rnd.choice([None, *range(300)]) if k % 9 == 0 else k, rnd.choice(["web", "", None, "books"]), rnd.choice(texts) if k % 3 else texts[7]) for k in range(400)]
    rows += rows[:60]  # repeated rows, nulls among them
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, s, t, 0, "k", 1) for i, s, t in rows], "doc_id long, source string, text string, mask int, part string, n int")
    return rows, labels, docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def figures(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_against_filters_one_after_another(spark):
    rows, labels, docs, known = table(spark)
    want = plain(rows, labels)
    assert figures(filter_audit.audit(docs, known)) == want
    small = filter_audit.masks(docs, block=3000, range_bytes=400_000)  # many blocks and ranges
    assert figures(filter_audit.interactions(filter_audit.counts(small, known))) == want
    assert small.agg(F.sum("n")).head()[0] == len(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    got = figures(filter_audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), labels))
    assert len(got) == 600 and got["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0) and got["", "BACDE", 2] == (0, 1, 0, 1, 0, 0, 120)


def test_trie_and_bounds():
    rnd = random.Random(1)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    trie, nodes, least = filter_audit.TextTrie(), {}, {}
    for i, t in enumerate(texts):
        who = rnd.randrange(10_000) if i % 5 else None
        assert nodes.setdefault(t, trie.insert(t, who)) == trie.insert(t, None)
        if who is not None:
            least[t] = min(who, least.get(t, who))
    assert len(set(nodes.values())) == len(nodes)
    nodes = {t: trie.insert(t, None) for t in nodes}
    assert {t: trie.least[k] for t, k in nodes.items() if trie.least[k] is not None} == least
    cuts = filter_audit.bounds([(b"abc%03d" % i, 1) for i in range(100)] + [(b"hot", 100)], 8)
    assert cuts == sorted(cuts) and len(cuts) <= 7 and cuts[0] == b"abc025"
    assert filter_audit.bounds([], 8) == [] and filter_audit.bounds([(b"one", 5)] * 9, 4) == []
