import datetime
import random

import pytest

from factloom.operators import intervals
from factloom.operators.running import with_sum_before


@pytest.mark.parametrize("group", [None, "g"])
def test_sums_before_are_those_of_one_sorted_list(spark, group):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 0, 0, 0, 3, 7]), rnd.choice([None, "a", "a", "a", "b", "c"]), rnd.choice([None, 1, 2, 50])) for i in range(900)]
    df = spark.createDataFrame(rows, "i long, at int, g string, cost long").repartition(5)
    got = with_sum_before(df, "cost", "at", group, n=7).collect()
    assert len(got) == len(rows)
    for g in {r.g for r in got} if group else {None}:
        mine = [r for r in got if not group or r.g == g]
        # nulls first, ties in an order of their own: sums before rise by the costs, one after another
        mine.sort(key=lambda r: (r["at"] is not None, r["at"] or 0, r.sum_before, r.cost or 0))
        total = 0
        for r in mine:
            assert r.sum_before == total
            total += r.cost or 0
    assert with_sum_before(df.limit(0), "cost", "at", group).count() == 0


def test_no_task_sorts_everything(spark):
    df = spark.range(100).selectExpr("id", "id cost")
    plan = with_sum_before(df, "cost", "id")._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan.lower() or "Scan ExistingRDD" in plan
    got = with_sum_before(df, "cost", "id", n=16).orderBy("id").collect()
    assert [r.sum_before for r in got] == [i * (i - 1) // 2 for i in range(100)]


def test_days_in_intervals(spark):
    rnd, first = random.Random(6), datetime.date(2024, 1, 1)
    day = lambda n: first + datetime.timedelta(days=n)
    some = lambda: None if rnd.random() < 0.2 else day(rnd.randint(-300, 900))
    rows = [(i, rnd.choice("pq"), some(), some()) for i in range(400)] + [(400, "p", day(5), day(5)), (401, "q", day(9), day(3))]
    for days in ([0], [0, 1], [7, 7], sorted(rnd.sample(range(700), 90)), list(range(64)), list(range(65))):
        df = spark.createDataFrame(rows, "i int, k string, valid_from date, valid_to date")
        asked = spark.createDataFrame([(day(n), n) for n in days] + [(None, -1)], "day date, number int")
        want = sorted((i, n) for i, _, a, b in rows for n in days if (a is None or a <= day(n)) and (b is None or b >= day(n)))
        assert sorted((r.i, r.number) for r in intervals.holding(df, asked).collect()) == want
        tally = {}
        for i, n in {(i, n) for i, n in want}:
            tally[day(n), rows[i][1]] = tally.get((day(n), rows[i][1]), 0) + 1
        assert {(r.day, r.k): r.n for r in intervals.counts(df, asked, ["k"]).collect()} == tally
    plan = intervals.holding(df, asked)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = asked.where("number < 0")
    assert intervals.holding(df, none).count() == 0 and intervals.counts(df, none, ["k"]).count() == 0
