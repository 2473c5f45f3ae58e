import datetime
import random

from factloom.operators import facts as O
from factloom.plans import streams
from factloom.streaming import keyed

SCHEMA = "id string, seq long, subject_id string, predicate string, canonical_value string, valid_from date, valid_to date"


def batches(n=3, rows=220):
    """Facts of few keys and days, in no order of days; some come again, some have no day or a given end."""
    rnd, day = random.Random(9), lambda: datetime.date(2024, 1, rnd.randint(1, 28))
    made = [(f"f{i:04}", i, f"s{rnd.randrange(4)}", rnd.choice(["view", "signup", "purchase", "other"]), rnd.choice(["1", "1", "2", None]) if i % 5 else "1",
             day() if rnd.random() < 0.9 else None, datetime.date(2024, 3, 1) if rnd.random() < 0.1 else None) for i in range(rows)]
    made += [(f"lone{i}", 1000 + i, f"only{i}", "view", "7", day(), None) for i in range(5)]
    rnd.shuffle(made)
    return [made[k::n] + made[: 7 * k] for k in range(n)]


def test_late_facts_and_restarts_end_as_the_batch_does(spark, tmp_path):
    known = spark.createDataFrame([("view", True, False), ("signup", False, False), ("purchase", True, True)], "predicate string, time_varying boolean, allow_multi boolean")
    source, path, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    everything = {}
    for part in batches():
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        everything |= {r[0]: r for r in part}
        # a query of its own each time, going on from the checkpoint
        keyed.detect_with_state(spark.readStream.schema(SCHEMA).parquet(source), known, path, checkpoint).awaitTermination()
        facts = spark.createDataFrame(list(everything.values()), SCHEMA)
        changed = keyed.read_changes(spark, path)
        of = lambda df: sorted((r.id, r.subject_id, r.predicate, tuple(r.competing_fact_ids), r.status) for r in df.collect())
        assert of(keyed.current_conflicts(changed)) == of(O.detect_conflicts(facts, known)) != []
        ends = lambda df: {r.id: r.valid_to for r in df.collect()}
        assert ends(keyed.with_current_ends(facts, changed)) == ends(O.supersede(facts, known))
    assert changed.select("batch").distinct().count() == 3
    keyed.detect_with_state(spark.readStream.schema(SCHEMA).parquet(source), known, path, checkpoint).awaitTermination()
    assert keyed.read_changes(spark, path).count() == changed.count()  # nothing came, nothing changes


def test_state_is_kept_without_calls_from_python(spark, tmp_path):
    known = spark.createDataFrame([("view", True, False)], "predicate string, time_varying boolean, allow_multi boolean")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    changes = keyed.changes(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), known)
    plan = changes._jdf.queryExecution().analyzed().toString()
    assert "InPySpark" not in plan and "InPandas" not in plan and "Deduplicate" in plan


def test_facts_come_in_three_batches(spark):
    _, changed = streams._changed(spark, "/root/testdata/sf0.001")
    assert changed.select("batch").distinct().count() == 3
