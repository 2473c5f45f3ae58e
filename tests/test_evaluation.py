import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluation as E

from .helpers import one, texts


@pytest.mark.parametrize("answer,expected,share", [
    ("Zoé habite à Nice", ["Zoe", "NICE"], 1.0), ("Zoe", ["Zoé|x", "lyon"], 0.5), ("any", ["zzz|"], 0.0), ("any", [], 1.0), ("any", ["", "  "], 1.0),
    ("une prescription", ["ordonnance|prescription"], 1.0), (None, ["a"], 0.0), ("INGÉNIEUR", ["ingenieur "], 1.0), ("a|b", ["|"], 1.0),
])
def test_coverage(spark, answer, expected, share):
    assert one(spark, E.coverage(F.lit(answer).cast("string"), texts(*expected))) == share


@pytest.mark.parametrize("answer,entries,n", [("Élodie et Paul", ["elodie|x", "PAUL", "", "zzz"], 2), ("", ["a"], 0), ("a", [], 0)])
def test_forbidden(spark, answer, entries, n):
    assert one(spark, E.forbidden(F.lit(answer), texts(*entries))) == n


@pytest.mark.parametrize("answer,expected,value", [("Le corpus n’… N'apparaît pas ici", True, 1.0), ("Il NE DÉCRIT PAS", True, 1.0), ("no information", True, 1.0), ("Nice", True, 0.0), ("Nice", False, 1.0), (None, True, 0.0)])
def test_abstention(spark, answer, expected, value):
    assert one(spark, E.abstention(F.lit(answer).cast("string"), F.lit(expected))) == value


def test_documents_match_whatever_their_normal_form(spark):
    cover = lambda e, a: one(spark, E.document_coverage(texts(*e), texts(*a)))
    assert cover(["été", "5905ca2e"], ["été.pdf"]) == 0.5
    assert cover([], []) == cover([""], ["x"]) == 1.0 and cover(["a"], []) == 0.0


CASE = "case_id string, answer string, document_ids array<string>, expected_documents array<string>, expected_entities array<string>, expected_facts array<string>, expected_provenance array<string>, expected_conflicts array<string>, expected_temporal array<string>, expects_abstention boolean, forbidden_facts array<string>"
ROWS = [
    ("a", "Zoé 2019", ["doc1.pdf"], ["doc1"], ["zoe"], ["2019"], [], [], [], False, ["paul"]),
    ("b", "Paul", ["x"], ["doc1", "x"], ["zoe"], [], [], [], ["1990|paul"], True, ["paul"]),
]


def test_cases_runs_summary_and_gate(spark):
    scored = E.score_cases(spark.createDataFrame(ROWS, CASE))
    a, b = scored.orderBy("case_id").collect()
    assert a.passed and not b.passed
    assert (b.doc_coverage, b.entity_coverage, b.fact_coverage, b.temporal_accuracy, b.abstention_accuracy, b.forbidden_violations) == (0.5, 0.0, 1.0, 1.0, 0.0, 1)
    s = E.summary(scored).first()
    assert (s.cases, s.passed, s.failed, s.mean_doc_coverage, s.total_forbidden_violations) == (2, 1, 1, 0.75, 1)
    none = E.summary(scored.limit(0)).first()
    assert none.cases == 0 and none.total_forbidden_violations == 0
    runs = E.together(scored, scored.where("case_id = 'a'"))
    assert [tuple(r) for r in E.misaligned(runs).collect()] == [("b", 1, 2)]
    means = {r.case_id: r for r in E.aggregate_runs(runs, ["doc_coverage"]).collect()}
    assert means["a"].pass_rate == 1.0 and means["b"].doc_coverage_std == 0.0
    tags = spark.createDataFrame([("a", ["phase8", "fact-level"])], "case_id string, tags array<string>")
    got = {(r.bucket, r.metric): (r["mean"], r.ok) for r in E.gate(E.with_bucket(scored, tags)).collect()}
    assert got == {("fact-level", "fact_provenance_coverage"): (1.0, True), ("baseline", "doc_coverage"): (0.5, False), ("baseline", "entity_coverage"): (0.0, False), ("baseline", "fact_coverage"): (1.0, True)}


def test_costs_and_budget(spark):
    calls = spark.createDataFrame([(1, 1000, 10, 200, 300, 1.0), (2, 100, 10, 90, 90, 3.0)], "n int, prompt_tokens int, completion_tokens int, cache_write int, cache_read int, latency double")
    prices = {"prompt": 1.0, "cache_write": 2.0, "cache_read": 0.5, "completion": 10.0}
    priced = calls.withColumn("cost", E.call_cost(prices))
    assert [r.cost for r in priced.orderBy("n").collect()] == [500 + 400 + 150 + 100, 0 + 180 + 45 + 100]
    total = E.cost_summary(priced).first()
    assert (total.calls, total.cost, total.mean_latency) == (2, 1475.0, 2.0)
    assert [r.n for r in E.within_budget(priced, 1150.0, "n").collect()] == [1]
    assert E.within_budget(priced, 1150.1, "n").count() == 2
