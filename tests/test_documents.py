import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import corrections as C
from factloom.operators import documents as D
from factloom.operators import predicates as P

from .helpers import one, texts


def test_states_of_intake(spark):
    files = spark.createDataFrame([
        ("/in/a.pdf", True, "h1", None), ("/in/b.PDF", True, "h1", None), ("/in/c.xyz", True, "h2", None), ("/in/dir.pdf", False, None, None), ("/in/e.md", True, "known", None),
        ("/in/f.md", True, "h3", None), ("/in/g.md", True, "h4", False), ("/in/h.md", True, "h4", True), ("/in/.md", True, "h5", None)],
        "path string, is_file boolean, hash string, converted boolean")
    stored = spark.createDataFrame([("k", "known", "/in/z"), ("u", "older", "/in/f.md")], "document_id string, hash string, path string")
    got = {r.path[4:]: (r.status, r.document_id) for r in D.ingest_states(files, stored).collect()}
    assert got == {"a.pdf": ("ingested", None), "b.PDF": ("duplicate", None), "c.xyz": ("unsupported", None), "dir.pdf": ("failed", None), "e.md": ("duplicate", "k"),
                   "f.md": ("updated", "u"), "g.md": ("unsupported", None), "h.md": ("ingested", None), ".md": ("unsupported", None)}
    assert one(spark, D.mime_type(F.lit("x/Y.MD"))) == "text/markdown" and one(spark, D.mime_type(F.lit("x"))) == "application/octet-stream"
    assert one(spark, D.mime_type(F.lit("a.md"), F.lit("text/html"), F.lit(0.5))) == "text/html" and one(spark, D.mime_type(F.lit("a.md"), F.lit("text/html"), F.lit(0.4))) == "text/markdown"


def test_headers_and_focus(spark):
    none = texts()
    assert one(spark, D.with_headers(F.lit("t"), F.lit("2024-01-02"), none)) == "[DOCUMENT DATE: 2024-01-02]\n\nt"
    assert one(spark, D.with_headers(F.lit("t"), F.lit("2024-01-02"), texts("a", "b"))) == "[EXTRACTION FOCUS: prioritize entities of these types: a, b.]\n\n[DOCUMENT DATE: 2024-01-02]\n\nt"
    assert one(spark, D.with_headers(F.lit("t"), F.lit(""), none)) == "t"
    assert one(spark, D.focus_types(texts("work", "nothing", "finance"))) == ["employer", "role", "skill", "organization", "person", "amount", "date", "account"]
    assert len(one(spark, D.focus_types(texts(*D.FOCUS)))) == 10 and one(spark, D.focus_types(texts("other"))) == []
    assert one(spark, D.union_of_types(texts("Person", "date", "PERSON"), texts("DATE", "Skill", "skill"))) == ["Person", "date", "skill"]


def test_telling_lines(spark):
    text = "  first line \n\n| - | - |\n|---|---|\n| a | b | words enough |\nlast"
    assert one(spark, D.telling_lines(F.lit(text))) == "first line\n| a | b | words enough |\nlast"
    assert one(spark, D.telling_lines(F.lit("a" * 1000 + "\n" + "b" * 1000))) == "a" * 1000 + "\n" + "b" * 499
    assert one(spark, D.telling_lines(F.lit("a" * 1499 + "\nb"))) == "a" * 1499
    assert one(spark, D.telling_lines(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("raw,tags,reason", [
    ('{"tags": ["Work", "work", " legal ", "zzz", "food", "travel"], "rationale": " r "}', ["work", "legal", "food"], "r"), ('```json\n{"tags": ["food"]}\n```', ["food"], ""),
    ('Sure: {"tags": ["food"], "rationale": 3} ok', ["food"], ""), ("nothing", ["other"], "classifier response: invalid JSON"), ("[1]", ["other"], "classifier response: not an object"),
    ('{"tags": "work"}', ["other"], ""), ('{"tags": [1, null, "food"]}', ["food"], ""), (None, ["other"], "classifier response: invalid JSON"), ("{bad}", ["other"], "classifier response: invalid JSON"),
])
def test_classifier_answers(spark, raw, tags, reason):
    got = one(spark, D.classified(F.lit(raw).cast("string")))
    assert (got.tags, got.rationale) == (tags, reason)


def converted(body, nested, children=1, pictures=()):
    item = lambda p, t: {"parent": {"$ref": p}, "text": t}
    doc = {"body": {"children": [{"$ref": "#/x"}] * children}, "texts": [item("#/body", t) for t in body] + [item("#/pictures/0", t) for t in nested], "pictures": list(pictures)}
    return F.parse_json(F.lit(json.dumps(doc)))


@pytest.mark.parametrize("body,nested,children,quality", [(["a", "b", "c"], [], 1, "rich"), (["a", " "], ["x"], 1, "degraded"), ([], ["x"], 1, "degraded"), ([], ["x"], 0, "empty"), ([], [" "], 1, "empty"), (["a", "b", "c"], [], 0, "rich")])
def test_extraction_quality(spark, body, nested, children, quality):
    assert one(spark, D.extraction_quality(converted(body, nested, children))) == quality


def test_fallback_markdown(spark):
    refs = lambda *r: {"children": [{"$ref": x} for x in r] + ["odd", {}]}
    doc = converted(["one"], [" two ", "", "four"], pictures=[refs("#/texts/1", "#/texts/2", "#/texts/99", "#/pictures/1"), refs("#/texts/2"), refs("#/texts/3", "#/texts/0")])
    assert one(spark, D.fallback_markdown(doc)) == "## Picture 1\n\ntwo\n\n## Picture 3\n\nfour\n\none"
    assert one(spark, D.fallback_markdown(F.parse_json(F.lit("{}")))) == ""


def test_doubts(spark):
    got = one(spark, D.doubts(F.lit("degraded"), F.lit(None).cast("date")))
    assert [(d.field, d.inferred_value, d.confidence, d.suggested_action, d.remedy) for d in got] == [("document_date", None, "low", "provide", False), ("extraction_quality", "degraded", "medium", "review", True)]
    assert [d.confidence for d in one(spark, D.doubts(F.lit("empty"), F.lit("2024-01-01")))] == ["high"] and one(spark, D.doubts(F.lit("rich"), F.lit("2024-01-01"))) == []
    assert one(spark, D.format_doubt(F.lit("a/B.PAGES"))).inferred_value == ".pages"


def test_versions_tags_and_prompt(spark):
    docs = spark.createDataFrame([("a", "n.pdf", "x", ["work"]), ("b", None, "y", []), (None, "q", "z", [])], "document_id string, original_filename string, content string, doc_context array<string>")
    assert [r.part for r in D.packed(docs).collect()] == ["\n\n=== /store/a/content.md (filename: n.pdf) ===\n\nx", "\n\n=== /store/b/content.md (filename: b) ===\n\ny"]
    tags = spark.createDataFrame([("b", ["food"])], "document_id string, tags array<string>")
    assert {r.document_id: r.doc_context for r in D.retagged(docs, tags).collect()} == {"a": ["work"], "b": ["food"], None: []}
    rows = spark.createDataFrame([("p", 1), ("p", 2), ("q", 5)], "path string, t int")
    assert {(r.path, r.version, r.is_current) for r in D.versions(rows, "path", "t").collect()} == {("p", 1, False), ("p", 2, True), ("q", 1, True)}


@pytest.mark.parametrize("text,good", [("12 rue de la Paix, 75002 Paris", True), ("12 rue\n de l'Église 06000  Nice", True), ("rue de la Paix 75002 Paris", False), ("12 rue 75 Paris", False), ("", False)])
def test_addresses(spark, text, good):
    assert one(spark, P.valid_address(F.lit(text))) is good


def test_predicates_from_responses(spark):
    docs = spark.createDataFrame([("d1", "2024-01-02", ["healthcare", "identity"]), ("d2", None, ["cv"]), ("d3", None, [])], "document_id string, document_date string, doc_context array<string>")
    answers = {
        ("d1", "address"): [{"entity_name": "Zoé", "address_text": "12 rue X, 75002 Paris", "components": {"street": "12 rue X", "postal_code": "75002", "city": "Paris"}}, {"entity_name": "Paul", "address_text": "nowhere  at all"}, {"entity_name": "", "address_text": "x"}, "text"],
        ("d1", "birthdate"): [{"entity_name": "Zoé", "birthdate_iso": "1980-02-31"}, {"entity_name": "Zoé", "birthdate_iso": "1980-02-03"}],
        ("d1", "diagnosis"): [{"patient_name": "patient", "diagnosis": " Flu "}], ("d1", "prescribed_medication"): [{"patient_name": "patient", "medication": "Aspirin"}],
        ("d2", "employer"): [{"employee_name": "Paul", "employer_name": "ACME   Corp", "period_start_iso": "2020-01-01", "period_end_iso": "2020-1-1"}],
        ("d3", "employer"): [{"employee_name": "X", "employer_name": "Y"}], ("d2", "address"): [{"entity_name": "X", "address_text": "Y"}],
    }
    responses = spark.createDataFrame([(d, p, "```json\n" + json.dumps(a) + "\n```") for (d, p), a in answers.items()], "document_id string, predicate string, response string")
    empty = spark.createDataFrame([], "id string")
    new = P.run(docs, responses, empty).cache()
    got = {(r.subject_id, r.predicate, r.canonical_value, str(r.valid_from), str(r.valid_to), r.confidence, r.source_location) for r in new.collect()}
    assert got == {
        ("entity:zoe", "address", "12 rue X, 75002 Paris", "2024-01-02", "None", "llm_high", "address:0"), ("entity:paul", "address", "nowhere at all", "2024-01-02", "None", "llm_low", "address:1"),
        ("entity:zoe", "birthdate", "1980-02-31", "None", "None", "llm_low", "birthdate:0"), ("entity:zoe", "birthdate", "1980-02-03", "None", "None", "llm_high", "birthdate:1"),
        ("entity:patient-d1", "diagnosis", "flu", "2024-01-02", "None", "llm_low", "diagnosis:0"), ("entity:patient-d1", "prescribed_medication", "aspirin", "2024-01-02", "None", "llm_low", "medication:0"),
        ("entity:paul", "employer", "ACME Corp", "2020-01-01", "None", "llm_high", "employer:0")}
    assert P.run(docs, responses, new.select("id")).count() == 0


def test_json_objects(spark):
    get = lambda s: one(spark, T.json_objects(F.lit(s).cast("string")))
    assert get('[{"a":1}, 2, "x", null, {"b":[1]}]') == ['{"a":1}', '{"b":[1]}'] and get("{}") == [] and get("bad") == [] and get(None) == []


def test_overlays(spark):
    docs = spark.createDataFrame([("d1", {"a": "1", "b": "2"}, ["x"], "the body"), ("d2", {"a": "1"}, ["x"], "the end")], "document_id string, metadata map<string,string>, tags array<string>, content string")
    fixes = spark.createDataFrame([("d1", {"b": "9", "c": "3"}, ["x", "y"], "d9", "p1", [("the", "THE"), ("", "no"), ("THE ", None)])], "document_id string, metadata map<string,string>, tags array<string>, replaced_by string, override_path string, replacements array<struct<find:string,replace:string>>")
    got = {r.document_id: (r.metadata, r.tags, r.replaced_by) for r in C.with_metadata_overlay(docs, fixes).collect()}
    assert got == {"d1": ({"a": "1", "b": "9", "c": "3"}, ["x", "y"], "d9"), "d2": ({"a": "1"}, ["x"], None)}
    bodies = lambda *r: spark.createDataFrame(list(r), "path string, body string")
    read = lambda b: {r.document_id: r.content for r in C.resolved_content(docs.select("document_id", "content"), fixes, b).collect()}
    assert read(bodies(("p1", "the other"))) == {"d1": "oTHEr", "d2": "the end"} and read(bodies(("p2", "z")))["d1"] == "body"


def test_doubts_aliases_and_review(spark):
    doubt = "array<struct<field:string>>"
    stored = spark.createDataFrame([("d1", "a.pdf", "reviewed", [("old",)], "mine"), ("d2", "b.pdf", "pending", [("kept",)], None)], f"document_id string, original_filename string, status string, doubts {doubt}, overrides string")
    emitted = spark.createDataFrame([("d1", "z", [("new",)]), ("d3", "c.pdf", [("x",), ("y",)])], f"document_id string, original_filename string, doubts {doubt}")
    merged = C.merged_doubts(stored, emitted).cache()
    assert {(r.document_id, r.original_filename, r.status, tuple(d.field for d in r.doubts), r.overrides) for r in merged.collect()} == {("d1", "a.pdf", "reviewed", ("new",), "mine"), ("d2", "b.pdf", "pending", ("kept",), None), ("d3", "c.pdf", "pending", ("x", "y"), None)}
    groups = spark.createDataFrame([(["Zoé", "Zoé M"],), (["Zoe", "zoe x"],), ([],)], "members array<string>")
    assert {(r.cluster, tuple(r.members)) for r in C.alias_corrections(groups).collect()} == {("zoe", ("Zoe", "zoe x")), ("zoe_2", ("Zoé", "Zoé M"))}
    entries = spark.createDataFrame([("b1", "pending", "n", "t"), ("b1", "pending", "m", None)], "bucket string, status string, name string, override_type string")
    fresh = spark.createDataFrame([("b1", "n", 1), ("b1", "new", 2)], "bucket string, name string, evidence int")
    assert {(r.name, r.evidence, r.override_type) for r in C.refreshed_entries(entries, fresh).collect()} == {("n", 1, "t"), ("new", 2, None)}
    aliases = spark.createDataFrame([("c1", "reviewed", ["a", "b"], None), ("c2", "pending", ["a"], "merge")], "cluster string, status string, members array<string>, action string")
    every = C.review(merged, entries, aliases, True).cache()
    assert {(r.layer, r.key, r.n, r.about) for r in C.review(merged, entries, aliases).collect()} == {("source", "d2", 1, "kept"), ("source", "d3", 2, "x, y"), ("entity-types", "b1", 2, "1 overridden"), ("aliases", "c2", 1, "action=merge")}
    assert {(r.layer, r.pending, r.reviewed) for r in C.stats(every).collect()} == {("source", 2, 1), ("entity-types", 1, 0), ("aliases", 1, 1)}
    assert [r.layer for r in C.shown(every, "c1").collect()] == ["aliases"]


def test_merge_operations(spark):
    schema = "cluster string, members array<string>, action string, canonical string, split_groups array<array<string>>"
    aliases = spark.createDataFrame([("m", ["A", "A B", "gone"], "merge", None, None), ("h", ["A", "A B"], "merge", "A", None), ("x", ["A", "A B"], "merge", "gone", None), ("s", [], "split", None, [["A", "C"], ["C"]]), ("e", ["A"], "split", None, []), ("v", ["A", "C"], "veto", None, None), ("a", ["A", "C"], None, None, None)], schema)
    nodes = spark.createDataFrame([("A",), ("A B",), ("C",)], "name string")
    got = {(r.cluster, r.part, r.canonical, tuple(r.sources or ()), r.warning) for r in C.merge_operations(aliases, nodes).collect()}
    assert got == {("m", 0, "A B", ("A",), "not in graph: gone"), ("h", 0, "A", ("A B",), None), ("x", 0, "A B", ("A",), "canonical not in graph: gone"), ("s", 0, "A", ("C",), None), ("e", None, None, (), "split without groups")}


def test_conflict_decisions(spark):
    conflicts = spark.createDataFrame([("1", "open"), ("2", "open"), ("3", "open"), ("4", "resolved_manually")], "id string, status string")
    made = spark.createDataFrame([("1", "reviewed", "w", False, None), ("2", "reviewed", None, False, ["a", "b"]), ("3", "open", "w", False, None), ("9", "reviewed", "w", False, None)], "conflict_id string, status string, winner string, coexist boolean, temporal_supersede_order array<string>")
    got = {r.id: (r.status, r.decision and (r.decision.winner, r.decision.coexist, r.decision.temporal_supersede_order)) for r in C.resolved_conflicts(conflicts, made).collect()}
    assert got == {"1": ("resolved_manually", ("w", None, None)), "2": ("resolved_temporally", (None, None, ["a", "b"])), "3": ("open", None), "4": ("resolved_manually", None)}
