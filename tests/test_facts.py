import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import facts as O
from factloom.sources import records
from factloom.streaming import conflicts as stream

from .helpers import one

DAY = datetime.date
SCHEMA = "seq long, subject_id string, predicate string, canonical_value string, source_doc_id string, valid_from date, valid_to date"


def facts(spark, *rows):
    return O.with_fact_id(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA))


@pytest.fixture(scope="module")
def contract(spark):
    return spark.createDataFrame([("address", True, False), ("birthdate", False, False), ("phone", True, True)], "predicate string, time_varying boolean, allow_multi boolean").cache()


def replaced(spark, contract, rows, chains=(("old", "new"),), dates=(("new", DAY(2024, 6, 1)),)):
    f = facts(spark, *rows)
    fixes = spark.createDataFrame([(o, n) for o, n in chains] + [("x", ""), ("y", None)], "document_id string, replaced_by string")
    day = spark.createDataFrame(list(dates), "document_id string, document_date date")
    r = O.replacements(f, O.replacement_chains(fixes), day, contract)
    return f, r, {(x.predicate, x.canonical_value, x.source_doc_id): x.valid_to for x in O.with_replaced_ends(f, r).collect()}


def test_replacement_ends(spark, contract):
    d = DAY(2020, 1, 1)
    _, _, got = replaced(spark, contract, [
        ("s", "address", "A", "old", d, None), ("s", "address", "B", "new", DAY(2024, 1, 10), None),
        ("s", "birthdate", "X", "old", None, None), ("s", "birthdate", "Y", "new", DAY(2024, 1, 10), None),
        ("s", "unknown", "1", "old", d, None), ("s", "unknown", "2", "new", DAY(2024, 1, 10), None),
        ("t", "address", "C", "old", d, DAY(2021, 1, 1)), ("t", "address", "D", "new", DAY(2024, 1, 10), None),
        ("u", "phone", "1", "old", d, None), ("u", "phone", "2", "new", None, None), ("v", "address", "E", "old", d, None)])
    assert got[("address", "A", "old")] == DAY(2024, 1, 9)
    assert got[("birthdate", "X", "old")] is None and got[("unknown", "1", "old")] is None and got[("address", "E", "old")] is None
    assert got[("address", "C", "old")] == DAY(2021, 1, 1)
    assert got[("phone", "1", "old")] == DAY(2024, 5, 31)


def test_conflicts_are_resolved_by_the_first_pair(spark, contract):
    f, r, _ = replaced(spark, contract, [
        ("s", "birthdate", "A", "old", None, None), ("s", "birthdate", "B", "old", None, None), ("s", "birthdate", "C", "new", None, None), ("s", "birthdate", "D", "new", None, None),
        ("t", "birthdate", "A", "old", None, None), ("t", "birthdate", "B", "x", None, None)])
    got = {x.subject_id: x for x in O.resolve_replaced(O.detect_conflicts(f, contract), r).collect()}
    ids = {(x.subject_id, x.canonical_value): x.id for x in f.collect()}
    assert got["s"].status == "resolved_temporally" and got["t"].status == "open" and got["t"].resolution is None
    assert tuple(got["s"].resolution) == (ids[("s", "D")], ids[("s", "A")], "replaced_by", "old", "new")


def test_supersession_and_points_in_time(spark, contract):
    f = facts(spark, ("s", "address", "A", "d", DAY(2020, 1, 1), None), ("s", "address", "B", "d", DAY(2021, 1, 1), None), ("s", "address", "C", "d", DAY(2021, 1, 1), None), ("s", "address", "N", "d", None, None), ("s", "birthdate", "X", "d", DAY(2019, 1, 1), None))
    done = O.supersede(f, contract)
    assert {x.canonical_value: x.valid_to for x in done.collect()} == {"A": DAY(2020, 12, 31), "B": None, "C": None, "N": None, "X": None}
    on = lambda d: {x.canonical_value for x in O.as_of(done, F.lit(d)).collect()}
    assert on(DAY(2020, 12, 31)) == {"A", "N", "X"} and on(DAY(2021, 1, 1)) == {"B", "C", "N", "X"} and on(DAY(2018, 1, 1)) == {"N"}


def test_detection_keeps_what_is_stored(spark, contract):
    f = facts(spark, ("s", "birthdate", "A", "d", None, None), ("s", "birthdate", "B", "e", None, None), ("s", "birthdate", "A", "f", None, None), ("s", "phone", "1", "d", None, None), ("s", "phone", "2", "d", None, None), ("t", "nickname", "x", "d", None, None), ("t", "nickname", "y", "d", None, None))
    found = O.detect_conflicts(f, contract).cache()
    assert {x.subject_id: len(x.competing_fact_ids) for x in found.collect()} == {"s": 3, "t": 2}
    stored = found.where("subject_id = 's'").select("id", F.array(F.lit("zz")).alias("competing_fact_ids"), F.lit("resolved_manually").alias("status"), F.lit("why").alias("resolution"))
    stored = stored.union(spark.createDataFrame([("gone", ["q"], "open", None)], "id string, competing_fact_ids array<string>, status string, resolution string"))
    again = {x.subject_id: x for x in O.rerun_conflicts(found, stored).collect()}
    assert set(again) == {"s", "t"} and again["s"].status == "resolved_manually" and again["s"].resolution == "why" and "zz" in again["s"].competing_fact_ids and again["t"].status == "open"
    new = O.detect_for_new(f.where("canonical_value = 'B'"), f, contract)
    assert [len(x.competing_fact_ids) for x in new.collect()] == [3]
    held = found.where("subject_id = 't'").withColumn("status", F.lit("resolved_manually"))
    both = {x.subject_id: x for x in O.with_new_conflicts(held, new).collect()}
    assert both["t"].status == "resolved_manually" and both["s"].status == "open" and len(both["s"].competing_fact_ids) == 3
    assert both["s"].id == {x.subject_id: x.id for x in found.collect()}["s"]


def test_lookups_and_details(spark, contract):
    f = facts(spark, ("s", "birthdate", "A", "d", None, None), ("s", "birthdate", "B", "e", DAY(2020, 1, 1), None), ("t", "phone", "1", "d", None, None)).cache()
    a, b, c = (x.id for x in f.orderBy("seq").collect())
    claims = O.claims(f.where("source_doc_id = 'd'"), F.lit("row"), "test").cache()
    conflicts = O.detect_conflicts(f, contract).cache()
    k = conflicts.first().id
    assert O.by_id(f, a).first().canonical_value == "A" and O.by_id(f, "x").count() == 0 and O.by_id(f, a.upper()).count() == 0
    assert O.of_subject(f, "s").count() == 2 and O.of_subject(f, "s", "phone").count() == 0
    assert O.claims_of(claims, a).count() == 1 and O.claims_of(claims, b).count() == 0
    assert [x.id for x in O.conflicts_with(conflicts, b).collect()] == [k] and O.conflicts_with(conflicts, c).count() == 0
    got = {x.id: (len(x.claims), [(r.id, r.status) for r in x.conflicts]) for x in O.fact_details(f, claims, conflicts).collect()}
    assert got == {a: (1, [(k, "open")]), b: (0, [(k, "open")]), c: (1, [])}
    gone = conflicts.withColumn("competing_fact_ids", F.array_append("competing_fact_ids", F.lit("gone")))
    assert {x.fact_id: (x.canonical_value, len(x.claims)) for x in O.conflict_details(gone, f, claims).collect()} == {a: ("A", 1), b: ("B", 0), "gone": (None, 0)}
    who = spark.createDataFrame([("s",), ("nobody",)], "entity_id string")
    assert {x.entity_id: x.n_facts for x in O.entity_snapshot(f, who).collect()} == {"s": 2, "nobody": 0}
    assert {x.entity_id: x.facts for x in O.entity_snapshot(f, who, F.lit(DAY(2019, 1, 1))).collect()} == {"s": [a], "nobody": []}
    assert tuple(O.totals(f, claims, conflicts).first()) == (3, 2, 1, 1)
    page = O.page(conflicts, "open", 1).collect()
    assert len(page) == 1 and page[0].total == 1


def test_registry_and_confidence(spark):
    rows = spark.createDataFrame([("a", True, False, 1), ("a", False, True, 2)], "predicate string, time_varying boolean, allow_multi boolean, seq int")
    assert [tuple(r)[:3] for r in O.registered(rows).collect()] == [("a", False, True)]
    values = [("1.0",), ("0.5",), ("0.49",), ("llm_high",), (None,)]
    assert one(spark, O.confidence_category(F.col("c")), values, "c string") == ["deterministic", "llm_high", "llm_low", "llm_high", None]


def test_record_store(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "v": "old"}\n\n{bad\n{"id": "2", "v": "x"}\n{"id": "1", "v": "new"}\n')
    schema = spark.createDataFrame([], "id string, v string").schema
    got = records.read_jsonl(spark, f"{tmp_path}/a.jsonl", schema)
    assert {tuple(r) for r in got.collect()} == {("1", "new"), ("2", "x")}
    rows = spark.createDataFrame([("1", "a"), ("3", "b"), ("4", "c"), ("4", "d")], schema)
    assert {r.id for r in records.append_new(spark, rows, f"{tmp_path}/a.jsonl", schema).collect()} == {"3", "4"}
    assert {tuple(r) for r in records.refused(rows, got).collect()} == {("1", "stored"), ("4", "repeated")}
    (tmp_path / "cases.json").write_text('{"cases": [{"id": "c1", "question": "q"}, {"id": "c2", "question": "r"}]}')
    assert [r.id for r in records.read_cases(spark, f"{tmp_path}/cases.json").collect()] == ["c1", "c2"]


def test_document_store_and_folder(spark, tmp_path):
    for name, about in (("d1", '{"document_id": "d1", "original_filename": "a.pdf", "document_date": "2024-01-02", "doc_context": ["work"]}'), ("d2", "{bad"), (".tmp-d3", "{}"), ("d4", None)):
        folder = tmp_path / "store" / name
        folder.mkdir(parents=True)
        (folder / "content.md").write_text("text")
        if about:
            (folder / "metadata.json").write_text(about)
    store = records.read_store(spark, f"{tmp_path}/store")
    assert {r.document_id for r in store.collect()} == {"d1", "d2"}
    assert [tuple(r) for r in records.document_maps(store).collect()] == [("d1", "a.pdf", "2024-01-02", ["work"], None)]
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for n in ("b.pdf", "a.txt", "sub/c.pdf"):
        (tmp_path / "in" / n).write_text(n)
    assert [r.path.rsplit("/", 1)[1] for r in records.read_folder(spark, f"{tmp_path}/in").collect()] == ["a.txt", "b.pdf"]


def test_stream_ends_where_the_batch_does(spark, tmp_path, contract):
    rows = [("s", "birthdate", v, f"d{i}", None, None) for i, v in enumerate("ABAC")] + [("t", "birthdate", "A", "x", None, None)]
    f = facts(spark, *rows)
    for i in range(3):
        f.where(f"seq % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = {}
    known = lambda: spark.read.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.detect_continuously(source, known, contract, lambda df, n: seen.update({r.id: r.competing_fact_ids for r in df.collect()}), f"{tmp_path}/check")
    q.awaitTermination(120)
    assert seen == {r.id: r.competing_fact_ids for r in O.detect_conflicts(f, contract).collect()}
