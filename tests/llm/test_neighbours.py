import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import neighbours


def brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = sorted((-float((y * q).sum()), j) for j, y in zip(ids, x) if j != i)
            out[i] = [j for _, j in s[:k]]
    return out


@pytest.mark.parametrize("n,copies", [(10, 3), (3000, 400)])
def test_recall_and_ties(spark, n, copies):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    x[: copies] = x[0]
    x = x * rng.choice([0.5, 1.0, 2.0], (n, 1)).astype(np.float32)
    x[: copies] = x[0]
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    bad = [(n + 20, None, 0), (n + 40, [0.0] * 16, 0), (n + 60, [float("nan")] * 16, 0), (n + 80, [None] * 16, 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows + rows[:2] + bad, "vec_id long, embedding array<float>, rank int")
    got: dict = {}
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float)))
    want = brute(list(range(n)), x.astype(np.float64), 20, 20)
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.9
    for q in range(0, copies, 20):
        best = [j for j in range(copies) if j != q][:20]
        if want[q][:20] == best:
            assert got[q] == best
    if n <= neighbours.BUCKET:
        assert got == want


def test_empty(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def answers(table, **kw):
    got: dict = {}
    for r in neighbours.nearest(table, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_distinct_vectors_that_tie_come_by_their_ids(spark, monkeypatch):
    # 45 different vectors of one inner product with the query, in any order
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 0.0, 0.0])] + [(int(i), [1.0, float(rng.uniform(-1, 1)), float(i)]) for i in rng.permutation(np.arange(1, 46))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers(table, every=100)[0] == list(range(1, 21))
    monkeypatch.setattr(neighbours, "BUCKET", 1000)
    assert answers(table, every=100)[0] == list(range(1, 21))


def test_split_buckets_and_scans_give_all(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((900, 8))
    x[:600] = x[0] + rng.normal(0, 1e-3, (600, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(list(range(900)), x, 20, 20)
    monkeypatch.setattr(neighbours, "HOT", 40)
    monkeypatch.setattr(neighbours, "SCANNED", 7)
    got = answers(table)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_scan_equals_brute_force_over_groups_and_parts(spark, monkeypatch):
    # every query is scanned: four groups of queries meet parts of the vectors; norms are large and products small
    monkeypatch.setattr(neighbours, "SCANNED", 10)
    monkeypatch.setattr(neighbours, "HELD", 40)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((400, 6)) * 1e6
    x[1::2] = x[0] * 0 + rng.integers(-2, 3, (200, 6))
    rows = [(x[i].tobytes(), [i]) for i in range(400)]
    distinct = spark.createDataFrame(rows, "v binary, ids array<long>").groupBy("v").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    few = spark.createDataFrame([(x[i].tobytes(),) for i in range(0, 400, 10)], "q binary")
    got = {bytes(r.q): [(f.s, f.i) for f in r.found] for r in neighbours._scanned(distinct, few, 400, float(np.linalg.norm(x, axis=1).max()), 6, 21).collect()}
    assert len(got) == 40
    for i in range(0, 400, 10):
        assert got[x[i].tobytes()] == sorted((-float((y * x[i]).sum()), j) for j, y in enumerate(x))[:21]


def test_bounds_lose_nothing_whatever_the_norms(spark):
    # all pairs meet in one bucket: what 32 bits round away doesn't drop any of the best, be norms equal or far apart
    rng = np.random.default_rng(13)
    x = rng.standard_normal((600, 12))
    x[100:200] = x[0] + rng.normal(0, 1e-9, (100, 12))
    x *= np.where(np.arange(600) % 50 == 7, 1e6, rng.choice([1e-6, 1.0], 600))[:, None]
    q = x[::20]
    exact = np.array([(x * v).sum(1) for v in q])
    kth = -np.sort(-exact, axis=1)[:, 20]
    for least in (np.full(len(q), -np.inf), kth):
        met = neighbours._Met(x, q, least, 21)
        for first in range(0, 600, 150):
            met.meet(np.arange(len(q)), first, first + 150)
        met.raised(over=True)
        left = set(zip(*(v.tolist() for v in met.pairs())))
        assert all((r, c) in left for r, c in zip(*np.nonzero(exact >= kth[:, None])))


def test_a_task_hands_on_no_more_than_a_query_needs(spark):
    # pairs of a query that several batches and tasks found are merged as plain sorting does, without comparing each two
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 40)), [(float(-rng.integers(0, 300)), int(rng.integers(0, 300))) for _ in range(21)]) for _ in range(4000)]
    found = spark.createDataFrame(rows, "query long, found array<struct<s:double,i:long>>").repartition(5)
    want: dict = {}
    for q, pairs in rows:
        want.setdefault(q, set()).update(pairs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    got = {r["query"]: [(f.s, f.i) for f in r.found] for r in neighbours._merged(found, "query", 21).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {q: sorted(pairs)[:21] for q, pairs in want.items()}
    held = neighbours.pa.table({"bucket": neighbours.pa.array(np.repeat(np.arange(4, dtype=np.int32), 50)), "v": [v.tobytes() for v in np.tile(rng.standard_normal((50, 8)), (4, 1))], "ids": [[i] for i in range(50)] * 4})
    asked = neighbours.pa.table({"query": [5], "v": [rng.standard_normal(8).tobytes()], "buckets": [np.arange(4, dtype=np.uint32).tobytes()], "least": [-np.inf]})
    _, lists = neighbours._Held(held, 8, "<f8").nearest(asked, 21, 4)
    assert len(lists[0]) == 21 and len({p["i"] for p in lists[0].as_py()}) == 21  # 84 before, each four times


def test_vectors_whose_squares_are_no_numbers(spark):
    # lengths come out as zero, or as infinite, and products as ties: all meet, and ids tell
    rng = np.random.default_rng(17)
    for size in (1e-200, 1e200):
        x = np.abs(rng.standard_normal((30, 4))) * size
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        assert answers(table, every=7) == {i: [j for j in range(30) if j != i][:20] for i in range(0, 30, 7)}


def test_a_task_hands_on_the_nearest_of_a_sample_once(spark):
    rng = np.random.default_rng(19)
    x = rng.standard_normal((500, 5))
    distinct = spark.createDataFrame([(v.tobytes(),) for v in x], "v binary").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    got = dict(neighbours._nearest_of(distinct, x[:7], 20, "<f8"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i in range(7):
        assert (got[i] == x[np.argsort(-(x @ x[i]))[:20]]).all()
