import datetime
import hashlib
import random

from pyspark.sql import functions as F

from factloom.operators import facts as O
from factloom.plans import lookups, queries
from factloom.sources import layout


def digest(*x):
    return hashlib.sha256("|".join(x).encode()).hexdigest()


def test_lookups_are_those_of_the_whole_tables(spark, tmp_path, monkeypatch):
    rnd = random.Random(8)
    rows = {}
    for i in range(400):
        s, p, v, d = f"s{rnd.randrange(30)}", rnd.choice(["view", "signup"]), rnd.choice("123"), f"d{rnd.randrange(20)}"
        rows[digest(s, p, v, d)] = (digest(s, p, v, d), i, s, p, v, d, datetime.date(2024, 1, 1 + i % 28), None if i % 3 else datetime.date(2024, 2, 1))
    f = spark.createDataFrame(list(rows.values()), "id string, seq long, subject_id string, predicate string, canonical_value string, source_doc_id string, valid_from date, valid_to date")
    known = spark.createDataFrame([("view", True, False)], "predicate string, time_varying boolean, allow_multi boolean")
    claims = O.claims(f.where("seq % 2 = 0").unionByName(f.where("seq % 4 = 0").withColumn("source_doc_id", F.lit("other"))), F.lit("row"), "test")
    conflicts = O.detect_conflicts(f, known).withColumn("status", F.when(F.substring("id", 1, 1) < "6", "resolved_manually").otherwise("open"))
    gone = conflicts.withColumn("competing_fact_ids", F.array_append("competing_fact_ids", F.lit("f" * 64)))
    layout.write_store(f"{tmp_path}/store", f, claims, gone)
    store = layout.Store(spark, f"{tmp_path}/store")

    ids = [*rnd.sample(sorted(rows), 6), "0" * 64, "x", rnd.choice(sorted(rows)).upper()]
    for i in ids:
        assert sorted(store.fact(i).collect()) == sorted(O.by_id(f, i).collect())
        assert sorted(r.id for r in store.claims_of(i).collect()) == sorted(r.id for r in O.claims_of(claims, i).collect())
        assert sorted(r.id for r in store.conflicts_with(i).collect()) == sorted(r.id for r in O.conflicts_with(gone, i).collect())
        whole = store.detail(i).collect()
        assert [(r.id, [c.id for c in r.claims], [c.id for c in r.conflicts]) for r in whole] == [
            (r.id, [c.id for c in r.claims], [c.id for c in r.conflicts]) for r in O.fact_details(O.by_id(f, i), claims, gone).collect()]
        for c in whole[0].conflicts if whole else ():
            assert i in c.competing_fact_ids
    for some in (layout.SOME, 2):
        monkeypatch.setattr(layout, "SOME", some)  # read by the driver alone
        k = conflicts.head().id
        got = {(r.fact_id, r.canonical_value, tuple(c.id for c in r.claims)) for r in store.conflict_detail(k).collect()}
        assert got == {(r.fact_id, r.canonical_value, tuple(c.id for c in r.claims)) for r in O.conflict_details(gone.where(F.col("id") == k), f, claims).collect()}
        assert ("f" * 64, None, ()) in got
    day = datetime.date(2024, 1, 9)
    assert sorted(store.of_subject("s3", day=day).collect()) == sorted(O.as_of(O.of_subject(f, "s3"), F.lit(day)).collect())
    assert store.of_subject("s3", "view").count() == O.of_subject(f, "s3", "view").count() and store.of_subject("nobody").count() == 0
    for status, limit in (("open", 5), (None, 11), ("resolved_manually", 1000), ("no such", 3)):
        want = conflicts if status is None else conflicts.where(F.col("status") == status)
        got = store.conflicts(status, limit).collect()
        assert [r.id for r in got] == sorted(r.id for r in want.collect())[:limit] and {r.total for r in got} <= {want.count()}


def test_the_scan_gets_the_bucket_and_the_key(spark, tmp_path):
    f = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.col("id").cast("string").alias("subject_id"))
    none = spark.createDataFrame([], "id string, fact_id string, status string, competing_fact_ids array<string>")
    layout.write_store(f"{tmp_path}/store", f, none.select("id", "fact_id"), none.drop("fact_id"))
    store = layout.Store(spark, f"{tmp_path}/store")
    key = f.head().id
    plan = store.fact(key)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "EqualTo(id," in plan.replace("In(id, [", "EqualTo(id,")
    assert len(store.fact(key).inputFiles()) >= 1 and store.fact(key).count() == 1
    assert store.detail(key).head().claims == [] and store.conflicts().count() == 0


def test_dealt_facts_are_superseded_where_they_are(spark):
    rows = [(digest(str(i)), i, f"s{i % 5}", ("view", "signup")[i % 2], str(i % 3), datetime.date(2024, 1, 1 + i * 7 % 28), None) for i in range(90)]
    f = spark.createDataFrame(rows, "id string, seq long, subject_id string, predicate string, canonical_value string, valid_from date, valid_to date")
    known = queries.predicates(spark)
    got = O.supersede(layout.dealt(f, "subjects", 1), known, ("bucket",))
    ends = lambda df: sorted((r.id, str(r.valid_to)) for r in df.collect())
    assert ends(got) == ends(O.supersede(f, known))
    plan = O.supersede(layout.dealt(f, "subjects", 1), known, ("bucket",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_only_tables_that_a_lookup_needs_are_written(spark, tmp_path):
    spark.range(40).selectExpr("id as event_id", "id % 3 as user_id", "'view' as event_type", "id % 4 + 0.5D as value", "timestamp '2024-01-05 00:00:00' + make_dt_interval(cast(id % 5 as int)) as ts").write.parquet(f"{tmp_path}/events.parquet")
    d = str(tmp_path)
    assert queries.FOUND["subject_facts"](spark, d).count() == 13
    assert lookups.store(spark, d, "subjects").tables == {"subjects"}
    assert queries.FOUND["fact_lookup"](spark, d).count() == 1 and lookups.store(spark, d).tables == {"subjects", "facts"}
    got = queries.FOUND["fact_detail_one"](spark, d).head()
    assert got.conflicts.count(",") == 12 and lookups.store(spark, d).tables == {"subjects", "facts", "claims", "conflicts", "members"}
