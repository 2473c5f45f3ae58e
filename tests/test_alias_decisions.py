"""Overrides of alias corrections: defaults, refusals and what goes on to merging."""

from factloom.operators import corrections as C

ROWS = [
    ("none", ["a"], None, "accept", None, [], None),
    ("blank", ["a"], "", "accept", None, [], None),
    ("nulls", ["a"], '{"action": null, "split_groups": null, "note": 1}', "accept", None, [], None),
    ("merge", ["a", "b"], '{"action": "merge", "canonical": "b"}', "merge", "b", [], None),
    ("split", ["a", "b", "c"], '{"action": "split", "split_groups": [["a", "b"], ["c"]]}', "split", None, [["a", "b"], ["c"]], None),
    ("unknown", ["a"], '{"action": "drop"}', "drop", None, [], "action"),
    ("empty", ["a"], '{"action": ""}', "", None, [], "action"),
    ("broken", ["a"], '{"action"', "accept", None, [], "overrides"),
    ("nobody", [], '{"action": "veto"}', "veto", None, [], "members"),
    ("null members", None, None, "accept", None, [], "members"),
]


def test_defaults_and_refusals(spark):
    rows = spark.createDataFrame([(c, m, "reviewed", o) for c, m, o, *_ in ROWS], "cluster string, members array<string>, status string, overrides string")
    got = {r.cluster: (r.action, r.canonical, r.split_groups, r.refused) for r in C.alias_decisions(rows).collect()}
    assert got == {c: (action, canonical, groups, refused) for c, _, _, action, canonical, groups, refused in ROWS}
    assert C.alias_decisions(rows.limit(0)).count() == 0


def test_decisions_go_on_to_merging(spark):
    rows = spark.createDataFrame([(c, m, "reviewed", o) for c, m, o, *_ in ROWS], "cluster string, members array<string>, status string, overrides string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    found = C.merge_operations(C.alias_decisions(rows).where("refused is null"), nodes).where("canonical is not null").collect()
    assert ("merge", "b", ["a"]) in [(r.cluster, r.canonical, r.sources) for r in found]
    assert {r.cluster for r in found} <= {"merge", "split"}
