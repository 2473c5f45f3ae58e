"""Answer scoring, run aggregation, costs and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .running import with_sum_before

#: Phrases (folded) by which an answer says that it lacks evidence.
ABSTENTION_MARKERS = (
    "insuffisant", "insuffisamment", "pas suffisamment", "ne dispose pas", "ne contient pas", "ne contient aucun",
    "n'apparait pas", "n apparait pas", "absent du corpus", "aucune information", "non disponible",
    "impossible de determiner", "ne decrit pas", "ne mentionne pas", "ne traite pas", "ne concerne pas",
    "ne porte pas sur", "ne fait pas mention", "n'evoque pas", "n evoque pas", "insufficient", "no information",
    "cannot determine", "not enough", "do not have sufficient", "does not contain sufficient",
    "does not contain enough", "lacks sufficient", "does not describe", "does not mention", "does not cover",
)
#: The buckets of the gate, by tag, in order of precedence, with their floors.
FLOORS = {
    "fact-level": {"fact_provenance_coverage": 0.80}, "adversarial": {"conflict_detection_coverage": 0.90},
    "phase8": {"temporal_accuracy": 0.80}, "phase8b6": {"abstention_accuracy": 0.75},
    "baseline": {"doc_coverage": 0.65, "entity_coverage": 0.85, "fact_coverage": 0.80},
}
COVERAGES = {"entity_coverage": "expected_entities", "fact_coverage": "expected_facts", "fact_provenance_coverage": "expected_provenance",
             "conflict_detection_coverage": "expected_conflicts", "temporal_accuracy": "expected_temporal"}
METRICS = ("doc_coverage", *COVERAGES, "abstention_accuracy")


def _mentioned(e: Column) -> Column:
    """Whether any '|' alternative of a folded entry is in a folded answer, of {entry, answer}; empty alternatives count
    nothing, an entry of bars alone stands for itself."""
    alone = (F.replace(F.trim(e["entry"]), F.lit("|"), F.lit("")) == "") & F.contains(e["answer"], F.trim(e["entry"]))
    return alone | F.exists(F.split(e["entry"], r"\|"), lambda a: (F.trim(a) != "") & F.contains(e["answer"], F.trim(a)))


def folded_list(entries: Column) -> Column:
    """A list folded at once: its entries, in which no line break may be, joined and folded as one text; blank entries
    are dropped."""
    one = F.array_join(F.transform(F.coalesce(entries, F.array().cast("array<string>")), lambda e: F.replace(e, F.lit("\n"), F.lit(" "))), "\n")
    return F.filter(F.split(T.fold(one), "\n"), lambda e: F.trim(e) != "")


def _with_each(items: Column, name: str, value: Column, other: str) -> Column:
    """``items`` as structs that also hold ``value``, which lambdas can't refer to where Python makes it."""
    return F.arrays_zip(items.alias(name), F.array_repeat(value, F.size(items)).alias(other))


def _hits(answer: Column, folded: Column) -> Column:
    return F.size(F.filter(_with_each(folded, "entry", T.fold(F.coalesce(answer, F.lit(""))), "answer"), _mentioned))


def coverage(answer: Column, expected: Column) -> Column:
    """Share of expected entries in the answer, whatever accents and case, any '|' alternative counting; 1.0 if nothing
    is expected."""
    folded = folded_list(expected)
    return F.when(F.size(folded) == 0, F.lit(1.0)).otherwise(_hits(answer, folded) / F.size(folded))


def forbidden(answer: Column, entries: Column) -> Column:
    """Number of forbidden entries of which an alternative is in the answer."""
    return _hits(answer, folded_list(entries))


def abstention(answer: Column, expected: Column, markers: tuple[str, ...] = ABSTENTION_MARKERS) -> Column:
    """1.0 where abstaining isn't expected, else whether a marker (folded already) is in the answer."""
    known = F.array(*(F.lit(m.lower()) for m in markers))
    found = F.exists(_with_each(known, "marker", T.fold(F.coalesce(answer, F.lit(""))), "answer"), lambda x: F.contains(x["answer"], x["marker"]))
    return F.when(~F.coalesce(expected, F.lit(False)), F.lit(1.0)).otherwise(found.cast("double"))


def document_coverage(expected: Column, cited: Column) -> Column:
    """Share of expected prefixes that a cited file name begins with, all in normal form C; 1.0 if none is expected."""
    prefixes = F.filter(F.split(T.composed(F.array_join(expected, "\n")), "\n"), lambda p: p != "")
    names = F.split(T.composed(F.array_join(cited, "\n")), "\n")
    hits = F.filter(_with_each(prefixes, "prefix", names, "names"), lambda x: F.exists(x["names"], lambda n: n.startswith(x["prefix"])))
    return F.when(F.size(prefixes) == 0, F.lit(1.0)).otherwise(F.size(hits) / F.size(prefixes))


def score_cases(cases: DataFrame) -> DataFrame:
    """Seven metrics and the forbidden count of each row (answer, document_ids, expected_*, expects_abstention,
    forbidden_facts); passed where all metrics are 1.0 and nothing forbidden is there."""
    rows = cases.withColumn("doc_coverage", document_coverage(F.col("expected_documents"), F.col("document_ids")))
    for metric, column in COVERAGES.items():
        rows = rows.withColumn(metric, coverage(F.col("answer"), F.col(column)))
    rows = rows.withColumn("abstention_accuracy", abstention(F.col("answer"), F.col("expects_abstention")))
    rows = rows.withColumn("forbidden_violations", forbidden(F.col("answer"), F.col("forbidden_facts")))
    passed = F.col("forbidden_violations") == 0
    for m in METRICS:
        passed = passed & (F.col(m) == 1.0)
    return rows.withColumn("passed", passed)


def aggregate_runs(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over the runs of a case, and its pass rate."""
    measures = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return results.groupBy("case_id").agg(F.count(F.lit(1)).alias("runs"), *measures, F.avg(F.col("passed").cast("double")).alias("pass_rate"))


def misaligned(runs: DataFrame) -> DataFrame:
    """(case_id, runs, expected) of the cases that aren't in every run (run_id, case_id) just once: runs can only be
    aggregated where there are none."""
    n = runs.agg(F.count_distinct("run_id").alias("expected"))
    each = runs.groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("run_id").alias("runs"))
    return each.crossJoin(F.broadcast(n)).where("runs <> expected or rows <> expected").select("case_id", "runs", "expected")


def together(*runs: DataFrame) -> DataFrame:
    """The results of several runs with their number from 0 as run_id."""
    out = runs[0].withColumn("run_id", F.lit(0))
    for i, run in enumerate(runs[1:], 1):
        out = out.unionByName(run.withColumn("run_id", F.lit(i)))
    return out


def summary(results: DataFrame) -> DataFrame:
    """One row: cases, passed, failed, the mean of each metric, and all forbidden entries found."""
    means = [F.avg(m).alias(f"mean_{m}") for m in METRICS]
    return results.agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), *means,
                       F.coalesce(F.sum("forbidden_violations"), F.lit(0)).alias("total_forbidden_violations"))


def bucket(tags: Column, buckets: tuple[str, ...] = tuple(FLOORS)[:-1]) -> Column:
    """The first bucket whose tag is among ``tags``, else 'baseline'."""
    out = F
    for b in buckets:
        out = out.when(F.array_contains(tags, b), F.lit(b))
    return out.otherwise("baseline")


def with_bucket(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Results with the bucket of their case's tags (case_id, tags); a case that isn't known has none, so 'baseline'."""
    tags = cases.select("case_id", "tags")
    return results.join(tags, "case_id", "left").withColumn("bucket", bucket(F.coalesce("tags", F.array().cast("array<string>")))).drop("tags")


def gate(results: DataFrame, floors: dict[str, dict[str, float]] = FLOORS) -> DataFrame:
    """(bucket, metric, mean, floor, ok) for the buckets that have results; a missing value counts 0."""
    rows = [(b, m, v) for b, own in floors.items() for m, v in own.items()]
    limits = results.sparkSession.createDataFrame(rows, "bucket string, metric string, floor double")
    metrics = sorted({m for _, m, _ in rows})
    long = results.select("bucket", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("v")) for m in metrics))).alias("s")).select("bucket", "s.*")
    means = long.groupBy("bucket", "metric").agg(F.avg("v").alias("mean"))
    return means.join(limits, ["bucket", "metric"]).withColumn("ok", F.col("mean") >= F.col("floor"))


def call_cost(prices: dict[str, float]) -> Column:
    """Cost of a call (prompt_tokens, completion_tokens, cache_write, cache_read): cached prompt tokens aren't paid as
    plain ones too. Prices a token: prompt, completion, cache_write, cache_read."""
    plain = F.greatest(F.lit(0), F.col("prompt_tokens") - F.col("cache_write") - F.col("cache_read"))
    parts = ((plain, "prompt"), (F.col("cache_write"), "cache_write"), (F.col("cache_read"), "cache_read"), (F.col("completion_tokens"), "completion"))
    return sum((n * F.lit(prices[k]) for n, k in parts), F.lit(0.0))


def cost_summary(calls: DataFrame) -> DataFrame:
    """One row: calls, tokens, cost and mean latency of calls with a cost."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "cache_write", "cache_read")]
    return calls.agg(F.count(F.lit(1)).alias("calls"), *sums, F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.avg("latency").alias("mean_latency"))


def within_budget(calls: DataFrame, budget: float, order: str, group: str | None = None) -> DataFrame:
    """The calls made while what was spent before them is below ``budget``, in order, within each ``group``."""
    return with_sum_before(calls, "cost", order, group, "spent_before").where(F.col("spent_before") < budget)
