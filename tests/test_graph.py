import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import graph as G
from factloom.operators import merges as M

from .helpers import one, texts


@pytest.mark.parametrize("a,b,same", [
    ("NICE", "Nice", True), ("Sébastien Boutet", "Sebastien Jean Christophe Boutet", True), ("SEBASTIEN BOUTET", "Sébastien  Boutet ", True), ("Véhicule +", "vehicule", True),
    ("Picture 1", "Picture 2", False), ("Plan A Miniers", "Plan A Technologiques", False), ("Boutet Sebastien", "Sebastien Jean Boutet", False), ("", "x", False), ("", "", False), (None, "x", False),
])
def test_lexical_equality(spark, a, b, same):
    assert one(spark, T.lexically_equal(F.lit(a).cast("string"), F.lit(b).cast("string"))) is same


@pytest.mark.parametrize("name,want", [("Zoé", "entity:zoe"), ("Dr. Jean-Paul  Œ", "entity:dr-jean-paul"), ("!!!", "entity:unknown"), ("", "entity:unknown"), (None, "entity:unknown"), ("unnamed", "entity:unnamed")])
def test_subject_ids(spark, name, want):
    assert one(spark, T.subject_id(F.lit(name).cast("string"))) == want


def plain_aliases(rows, threshold):
    """Pairs, ambiguous nodes and groups by comparing all."""
    def words(n):
        return n.lower().split()

    def equal(a, b):
        s, l = sorted((words(a), words(b)), key=len)
        rest = iter(l)
        return bool(s) and all(w in rest for w in s)

    edges = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[2] == b[2] and a[2] in G.CLUSTERABLE and equal(a[1], b[1]) and round(sum(x * y for x, y in zip(a[3], b[3])), 4) >= threshold}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    bad = {v for v, n in near.items() if any((min(x, y), max(x, y)) not in edges for x, y in itertools.combinations(n, 2))}
    cluster = {r[0]: min([r[0], *(n for n in near.get(r[0], ()) if n not in bad and r[0] not in bad)]) for r in rows}
    return edges, bad, {tuple(sorted({v, *near[v]})) for v in bad}, cluster


def test_aliases_equal_a_plain_search(spark):
    rng = random.Random(2)
    name = lambda: " ".join(sorted(rng.sample(["ana", "Bob", "cy", "DAN", "eve"], rng.randint(1, 3)), key=str.lower))
    rows = [(i, name(), rng.choice(["person", "location", "amount"]), [rng.choice([1.0, 0.8, 0.5]), 1.0]) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, name string, entity_type string, embedding array<double>")
    edges, bad, groups, cluster = plain_aliases(rows, 1.5)
    got = G.alias_edges(df, 1.5).cache()
    assert {(r.a, r.b) for r in got.collect()} == edges and edges and bad
    assert {r.name for r in G.ambiguous(got).collect()} == bad
    assert {tuple(r.members) for r in G.ambiguous_groups(got).collect()} == groups
    assert {r.name: r.cluster for r in G.alias_clusters(df.select(F.col("id").alias("name")), got).collect()} == cluster


def test_merges_and_edges(spark):
    assert one(spark, G.canonical(texts("Zoe B", "Zoe A", "Ana B", "Z"))) == "Ana B"
    clusters = spark.createDataFrame([("Zoe", 1), ("Zoe Martin", 1), ("Paul", 2), ("Gone", 3), ("Gone Too", 3)], "name string, cluster int")
    plan = G.merge_plan(clusters)
    assert {r.canonical: r.sources for r in plan.collect()} == {"Zoe Martin": ["Zoe"], "Gone Too": ["Gone"]}
    nodes = spark.createDataFrame([("Zoe", "x", "short", ["d1", "d2"]), ("Zoe Martin", "person", "long", ["d2", "d3"]), ("Paul", "person", None, [])], "name string, entity_type string, description string, document_ids array<string>")
    moved = M.moves(nodes, plan)
    got = {r.name: r for r in M.merged(nodes, moved).collect()}
    assert set(got) == {"Zoe Martin", "Paul"} and got["Zoe Martin"].entity_type == "person" and got["Zoe Martin"].description == "long<SEP>short" and got["Zoe Martin"].document_ids == ["d2", "d3", "d1"]
    edges = spark.createDataFrame([("Zoe", "Paul"), ("Paul", "Zoe Martin"), ("Zoe", "Zoe Martin")], "src string, tgt string")
    assert [tuple(r) for r in M.moved_edges(edges, moved).collect()] == [("Paul", "Zoe Martin")]


def test_types(spark):
    rows = [("  Person ",), ("Artifact ",), ("",), (None,)]
    t, o, r = G.normal_type(F.col("x"), ["PERSON"])
    got = [tuple(x) for x in spark.createDataFrame(rows, "x string").select(t, o, r).collect()]
    assert got == [("person", None, False), ("concept", "artifact", True), ("concept", None, True), ("concept", None, True)]
    nodes = spark.createDataFrame([("b", "concept", "artifact"), ("a", "concept", None), ("c", "person", "x")], "name string, entity_type string, original_entity_type string")
    assert {x.bucket: x.names for x in G.type_buckets(nodes).collect()} == {"concept_fallback": ["a", "b"], "remapped_singletons": ["b"]}
    over = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("q", "1", "z")], "name string, bucket string, new_type string")
    assert {x.name: x.entity_type for x in G.with_types(nodes, over).collect()} == {"a": "y", "b": "concept", "c": "person"}


DOCS = [("d1", "a_b-c.pdf", "2024-01-02", ["work", "legal"], "rich"), ("d2", "", None, [], None), ("d3", "z.pdf", "bad", None, "empty")]


def documents(spark):
    return spark.createDataFrame(DOCS, "document_id string, original_filename string, document_date string, doc_context array<string>, extraction_quality string")


def test_temporal_prefixes(spark):
    dates = G.document_dates(documents(spark))
    assert [(r.document_id, str(r.document_date)) for r in dates.collect()] == [("d1", "2024-01-02")]
    records = spark.createDataFrame([("n", "text", ["d1", "d2", "d1"]), ("m", "[sourced: 2020-01-01] x", ["d1"]), ("k", None, ["d2"])], "name string, description string, document_ids array<string>")
    got = {r.name: (r.description, r.annotated) for r in G.with_sources(records, dates).collect()}
    assert got == {"n": ("[sourced: 2024-01-02] text", True), "m": ("[sourced: 2020-01-01] x", False), "k": (None, False)}
    assert one(spark, G.without_source_prefix(F.lit(" [sourced: 2020-01-01, 2021-01-01] x "))) == "x"
    assert [str(one(spark, G.lenient_date(F.lit(x)))) for x in ("2020-01-02", "2020-01-02T10:00:00", "2020-1-2", "x")] == ["2020-01-02", "2020-01-02", "None", "None"]


def test_index_nodes_and_summaries(spark):
    nodes = spark.createDataFrame(
        [("Zoe", "person", ["d2", "d1", "gone"]), ("Paul", "person", ["d1"]), ("12 EUR", "amount", ["d1", "d2"]), ("Tx", "transaction", ["d1", "d2"]), ("Profile: Old", "entity_profile", ["d1", "d2"])],
        "name string, entity_type string, document_ids array<string>")
    plan = G.index_plan(nodes, documents(spark), hidden=("transaction",)).collect()
    assert [r.name for r in plan] == ["Profile: Zoe", "Catalog: person"]
    assert plan[0].description == "Profile of Zoe (type: person).\nAppears in 2 documents:\n  - /store/d1/content.md (a_b-c.pdf, date=2024-01-02, context=work/legal)\n  - /store/d2/content.md"
    assert plan[0].source_id == "d2" and plan[0].document_ids == ["d2", "d1"]
    assert plan[1].description == "Catalog of person entities across the corpus.\n2 entities found across 2 documents:\n  - Paul [/store/d1/content.md]\n  - Zoe [/store/d1/content.md, /store/d2/content.md]"
    many = spark.createDataFrame([("E", "person", [f"x{i:02}" for i in range(23)])], "name string, entity_type string, document_ids array<string>")
    store = spark.createDataFrame([(f"x{i:02}", "", None, None) for i in range(23)], "document_id string, original_filename string, document_date string, doc_context array<string>")
    said = G.profile_nodes(many, store).first().description.split("\n")
    assert len(said) == 23 and said[-1] == "  …and 3 more."
    kept = G.with_index_nodes(nodes, G.index_plan(nodes, documents(spark), hidden=("transaction",)).select("name", "entity_type", "document_ids"))
    assert sorted(r.name for r in kept.collect()) == ["12 EUR", "Catalog: person", "Paul", "Profile: Zoe", "Tx", "Zoe"]
    extras = spark.createDataFrame([("d1", 2, "second"), ("d1", 1, "first")], "document_id string, at int, line string")
    got = {r.full_doc_id: r.content for r in G.summaries(documents(spark), nodes, extras, ("transaction", "entity_profile")).collect()}
    assert got["d1"] == "Document: a_b-c.pdf\nFilename tokens: a b c.pdf\nDocument date: 2024-01-02\nDocument ID: d1\nExtraction quality: rich\nDocument context: work, legal\nKey entities: Paul, Zoe\nStructured highlights:\n  - first\n  - second"
    assert got["d2"].startswith("Document: unknown\nFilename tokens: unknown\nDocument date: unknown\nDocument ID: d2\nExtraction quality: unknown\nKey entities: Zoe")


def test_degrees(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "")], "name string, entity_type string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, tgt string")
    assert [(r.name, r.degree) for r in G.top_by_degree(nodes, edges, 2).collect()] == [("a", 1), ("b", 1)]
    assert tuple(G.isolation(nodes, edges).first()) == (3, 2, 1)
    stored, new = nodes, spark.createDataFrame([("a", "new"), ("z", "new")], "name string, entity_type string")
    assert {(r.name, r.entity_type) for r in G.upserted(stored, new, ["name"]).collect()} == {("a", "new"), ("b", "x"), ("c", ""), ("z", "new")}


def test_dense_graphs_are_judged_without_pairing_all_neighbours(spark):
    """Cliques that share nodes, two that are each other's only neighbours, and a circle of which only some are neighbours."""
    cliques = [range(0, 30), range(28, 50), range(60, 62), range(70, 76)]
    edges = {(a, b) for c in cliques for a, b in itertools.combinations(c, 2)} - {(70, 75), (71, 74)}
    near = {v: {x for e in edges if v in e for x in e if x != v} for e in edges for v in e}
    bad = {v for v, n in near.items() if any((min(x, y), max(x, y)) not in edges for x, y in itertools.combinations(n, 2))}
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    found = G.ambiguous(df)
    assert {r.name for r in found.collect()} == bad and 28 in bad and 60 not in bad
    nodes = spark.range(80).select(F.col("id").alias("name"))
    want = {v: min([v, *(n for n in near.get(v, ()) if not {v, n} & bad)]) for v in range(80)}
    assert {r.name: r.cluster for r in G.alias_clusters(nodes, df).collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4  # no join of neighbours with neighbours


def test_pairs_of_aliases_are_not_shuffled_and_tiles_meet_once(spark, monkeypatch):
    monkeypatch.setattr(G, "TILE", 7)  # read by the driver alone
    rng = random.Random(5)
    rows = [(i, rng.choice(["Ana", "ana Bob", "bob ana", "Ana x Bob"]), "person", [rng.choice([1.0, -1.0, 0.25]), 0.5]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string, entity_type string, embedding array<float>")
    got = G.alias_edges(df, 0.0)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(plain_aliases(rows, 0.0)[0])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.strip().startswith(("Filter", "Project")) and "MapInArrow" in plan.split("Join")[0] and "Aggregate" not in plan.split("MapInArrow")[0]
