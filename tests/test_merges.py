import random

import pytest

from factloom.operators import merges as M
from factloom.operators import reports as R

NODES = "name string, entity_type string, description string, document_ids array<string>"
PLAN = "op long, canonical string, sources array<string>"


def replay(nodes, plan):
    """One merge after another on a dictionary."""
    there = {n: (t, [x] if x else [], list(dict.fromkeys(d))) for n, t, x, d in nodes}
    root, outcome = {n: n for n in there}, {}
    for op, canonical, sources in sorted(plan):
        live = [s for s in dict.fromkeys(sources or []) if s in there and s != canonical]
        outcome[op] = "skipped" if not live else "applied" if canonical in there else "error"
        if outcome[op] == "applied":
            kind, text, docs = there[canonical]
            for s in live:
                text, docs = text + there[s][1], list(dict.fromkeys(docs + there.pop(s)[2]))
                root = {n: canonical if r == s else r for n, r in root.items()}
            there[canonical] = kind, text, docs
    return {n: (t, "<SEP>".join(x), d) for n, (t, x, d) in there.items()}, root, outcome


def check(spark, nodes, plan):
    n, p = spark.createDataFrame(nodes, NODES), spark.createDataFrame(plan, PLAN)
    want, root, outcome = replay(nodes, plan)
    moved = M.moves(n, p).cache()
    assert {r.name: (r.entity_type, r.description, r.document_ids) for r in M.merged(n, moved).collect()} == want
    assert {r.op: r.outcome for r in M.outcomes(n, p, moved).collect()} == outcome
    edges = [(a[0], b[0]) for a, b in zip(nodes, nodes[1:] + nodes[:1])]
    got = {(r.src, r.tgt) for r in M.moved_edges(spark.createDataFrame(edges, "src string, tgt string"), moved).collect()}
    assert got == {tuple(sorted((root[a], root[b]))) for a, b in edges if root[a] != root[b]}


@pytest.mark.parametrize("seed", range(4))
def test_random_plans_end_as_one_merge_after_another(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(30)]
    nodes = [(x, rnd.choice("pq"), rnd.choice([None, "", f"about {x}"]), rnd.sample(["d1", "d2", "d3", "d4"], 2)) for x in names]
    some = names + ["gone1", "gone2"]
    plan = [(op * 3, rnd.choice(some), rnd.choice([None, [], [rnd.choice([*some, None]) for _ in range(rnd.randint(1, 4))], [rnd.choice(some)]])) for op in range(40)]
    check(spark, nodes, [(o, c, s) for o, c, s in plan])


def test_a_merged_node_takes_in_nothing_more(spark):
    nodes = [(x, x, f"of {x}", [x]) for x in "abcd"]
    check(spark, nodes, [(1, "a", ["b"]), (2, "c", ["a"]), (3, "a", ["d"]), (4, "d", ["c"])])


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    # each merge would take away the canonical node of the next one, so every other merge holds
    rounds = []
    monkeypatch.setattr(M, "kept", lambda df, real=M.kept: rounds.append(1) or real(df))
    nodes = [(f"n{i:03}", "t", None, []) for i in range(130)]
    plan = spark.createDataFrame([(i, f"n{i:03}", [f"n{i + 1:03}"]) for i in range(129)], PLAN)
    moved = M.moves(spark.createDataFrame(nodes, NODES), plan)
    assert sorted(r.op for r in moved.collect()) == [i for i in range(129) if i % 2 == 0]
    assert len(rounds) <= 12


def test_reports_and_dry_runs(spark):
    nodes = spark.createDataFrame([("a", "x", "A", ["1"]), ("b", "y", "B", ["2"]), ("c", "y", "C", ["3"])], NODES)
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, tgt string")
    overrides = spark.createDataFrame([("a", "1", "z"), ("b", "1", "y"), ("none", "1", "z")], "name string, bucket string, new_type string")
    plan = spark.createDataFrame([(1, "a", ["b"]), (2, "none", ["c"]), (3, "c", ["b"])], PLAN)
    dry, nowhere = R.apply_plan(nodes, edges, overrides, plan, dry_run=True)
    report, path = R.apply_plan(nodes, edges, overrides, plan)
    want = {"types_applied": 1, "types_skipped": 2, "merges_applied": 1, "merges_skipped": 1, "merge_errors": 1}
    assert nowhere is None and dry.first().asDict() == report.first().asDict() == want
    after, links = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    assert {(r.name, r.entity_type, r.description) for r in after.collect()} == {("a", "z", "A<SEP>B"), ("c", "y", "C")}
    assert [tuple(r) for r in links.collect()] == [("a", "c")]
    again = R.apply_plan(after, links, overrides, plan)[0].first()
    assert (again.types_applied, again.merges_applied) == (0, 0)

    paths = spark.createDataFrame([("a", " Person", "x/store/11111111-1111-4111-8111-111111111111/content.md"), ("b", "odd", None)], "name string, entity_type string, file_path string")
    lines = spark.createDataFrame([("a", "b", "p"), ("b", "a", "q")], "src string, tgt string, file_path string")
    report, path = R.post_process(paths, lines, ["person"])
    assert report.first().asDict() == {"nodes_rewritten": 2, "edges_rewritten": 1, "entity_types_remapped": 1}
    assert {(r.name, r.entity_type, r.original_entity_type, r.document_ids) for r in spark.read.parquet(f"{path}/nodes").collect()} == {("a", "person", None, "11111111-1111-4111-8111-111111111111"), ("b", "concept", "odd", "")}

    dates = spark.createDataFrame([("1", "2024-01-02")], "document_id string, d string").selectExpr("document_id", "cast(d as date) document_date")
    about = spark.createDataFrame([("a", "A", "1<SEP>2"), ("b", "[sourced: 2020-01-01] B", "1"), ("c", None, None)], "name string, description string, document_ids string")
    lines = spark.createDataFrame([("a", "b", "links", "1"), ("b", "a", "links", "1"), ("b", "c", "x", "2")], "src string, tgt string, description string, document_ids string")
    report, path = R.annotate(about, lines, dates)
    assert report.first().asDict() == {"nodes_annotated": 1, "edges_annotated": 1, "dry_run": False}
    assert {r.description for r in spark.read.parquet(f"{path}/edges").collect()} == {"[sourced: 2024-01-02] links", "x"}
    empty = R.annotate(about.limit(0), lines.limit(0), dates, dry_run=True)
    assert empty[0].first().asDict() == {"nodes_annotated": 0, "edges_annotated": 0, "dry_run": True} and empty[1] is None


def test_an_edge_is_the_same_row_however_the_rows_come(spark):
    rows = [("b", "a", "x", [1]), ("a", "b", "y", [2]), ("c", "d", "z", None), ("d", "c", "z", [3]), ("e", "e", None, [])]
    # another order for each reading, as shuffles between executors have it
    both = [sorted(map(tuple, R.one_edge_each(spark.createDataFrame(r, "src string, tgt string, path string, ids array<int>").coalesce(1)).collect())) for r in (rows, rows[::-1])]
    assert both[0] == both[1] and [(r[0], r[1]) for r in both[0]] == [("a", "b"), ("c", "d"), ("e", "e")]
