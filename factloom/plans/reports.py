"""Queries of ordered merges and of passes that report what they change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as O
from ..operators import merges as M
from ..operators import reports as R
from .queries import _DETECTED, _REPLACED, _graph, _replaced, _uuid, FACTS97, predicates, query, table


def _plan(spark, d):
    """Vectors as nodes, and merges in which every node can be a source and a canonical one again and again."""
    v = table(spark, d, "embeddings")
    n, i = v.count(), F.col("vec_id")
    node = lambda x: F.concat(F.lit("k"), x)
    nodes = v.select(node(i).alias("name"), F.col("label").cast("string").alias("entity_type"), F.concat(F.lit("d"), i).alias("description"), F.array(F.concat(F.lit("d"), i % 7)).alias("document_ids"))
    plan = v.where("vec_id % 5 = 1").select(i.alias("op"), node((i * 7 + 3) % n).alias("canonical"), F.array(node(i), node((i * 3 + 1) % n), node((i * 11 + 5) % (n + 50))).alias("sources"))
    return nodes, plan


REPLAY = """with recursive size as (select count(*) as c from embeddings),
ops as (select row_number() over (order by vec_id) as k, vec_id as op, 'k' || ((vec_id * 7 + 3) % c) as canonical,
  list_filter(list_distinct(['k' || vec_id, 'k' || ((vec_id * 3 + 1) % c), 'k' || ((vec_id * 11 + 5) % (c + 50))]), lambda s: s <> 'k' || ((vec_id * 7 + 3) % c)) as srcs from embeddings, size where vec_id % 5 = 1),
asked as (select k, op, canonical, unnest(srcs) as s from ops),
known as (select k, any_value(op) as op, any_value(canonical) as canonical, list(s) as srcs from asked join (select 'k' || vec_id as name from embeddings) on name = s group by k),
run(k, op, canonical, dead, outcome) as (
  select 0::bigint, 0::bigint, '', []::varchar[], '' union all
  select o.k, o.op, o.canonical, case when list_contains(r.dead, o.canonical) then r.dead else list_concat(r.dead, list_filter(coalesce(n.srcs, []), lambda s: not list_contains(r.dead, s))) end,
    case when len(list_filter(coalesce(n.srcs, []), lambda s: not list_contains(r.dead, s))) = 0 then 'skipped' when list_contains(r.dead, o.canonical) then 'error' else 'applied' end
  from run r join ops o on o.k = r.k + 1 left join known n on n.k = o.k),
moved as (select b.op, b.canonical, unnest(b.dead[len(a.dead) + 1 :]) as source from run b join run a on a.k = b.k - 1),
up(name, root, hops) as (select source, canonical, 1 from moved union all select u.name, m.canonical, u.hops + 1 from up u join moved m on m.source = u.root),
ended as (select name, arg_max(root, hops) as root from up group by name)"""


@query(REPLAY + """ select coalesce(e.root, n.name) as name, cast(count(*) as bigint) as members, array_to_string(list_sort(list(n.name)), ',') as names, max(case when e.root is null then n.label end) as entity_type
from (select 'k' || vec_id as name, cast(label as varchar) as label from embeddings) n left join ended e on e.name = n.name group by 1""")
def merge_chains(spark, d):
    nodes, plan = _plan(spark, d)
    rows = M.merged(nodes, M.moves(nodes, plan))
    names = F.array_sort(F.transform(F.split("description", "<SEP>"), lambda x: F.replace(x, F.lit("d"), F.lit("k"))))
    return rows.select("name", "members", F.array_join(names, ",").alias("names"), "entity_type")


@query(REPLAY + " select op, canonical, outcome from run where k > 0")
def merge_outcomes(spark, d):
    nodes, plan = _plan(spark, d)
    return M.outcomes(nodes, plan, M.moves(nodes, plan)).select("op", "canonical", "outcome")


@query(REPLAY + """ select (select count(*) from embeddings where vec_id % 3 = 0 and label <> 4) as types_applied, (select count(*) from embeddings where vec_id % 3 = 0 and label = 4) + (select c from size) // 10 as types_skipped,
  count(*) filter (where outcome = 'applied') as merges_applied, count(*) filter (where outcome = 'skipped') as merges_skipped, count(*) filter (where outcome = 'error') as merge_errors from run where k > 0""")
def apply_plan_report(spark, d):
    nodes, plan = _plan(spark, d)
    v = table(spark, d, "embeddings")
    missing = v.where(f"vec_id < {v.count() // 10}").select(F.concat(F.lit("none"), "vec_id").alias("name"))
    overrides = v.where("vec_id % 3 = 0").select(F.concat(F.lit("k"), "vec_id").alias("name")).union(missing).select("name", F.lit("b").alias("bucket"), F.lit("4").alias("new_type"))
    edges = v.select(F.concat(F.lit("k"), "vec_id").alias("src"), F.concat(F.lit("k"), F.col("vec_id") + 1).alias("tgt"))
    return R.apply_plan(nodes, edges, overrides, plan)[0]


@query(FACTS97 + _DETECTED + _REPLACED + """ select (select count(*) from replaced where valid_to is not null) as facts_updated,
  (select count(distinct d.id) from detected d, replaced r where list_contains(d.members, r.old_id) and list_contains(d.members, r.new_id)) as conflicts_resolved""")
def replacement_report(spark, d):
    f = _replaced(spark, d)[0]
    docs = f.select("source_doc_id").distinct()
    number = F.substring("source_doc_id", 5, 9).cast("int")
    chains = O.replacement_chains(docs.select(F.col("source_doc_id").alias("document_id"), F.when(number % 10 == 0, F.concat(F.lit("doc:"), number + 1)).alias("replaced_by")))
    dates = docs.select(F.col("source_doc_id").alias("document_id"), F.lit("2024-06-01").cast("date").alias("document_date"))
    return R.apply_replacements(f, O.detect_conflicts(f, predicates(spark)), chains, dates, predicates(spark))[0]


def _described(spark, d):
    """Customers and their edges with the orders they come from."""
    nodes, edges, member = _graph(spark, d)
    docs = member.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set(F.col("document_id").cast("string"))), "<SEP>").alias("document_ids"))
    number = F.substring("name", 2, 12).cast("int")
    path = F.concat(F.lit("/x/store/"), _uuid(F.md5("name")), F.lit("/content.md"))
    nodes = nodes.join(docs, "name", "left").withColumns({"file_path": path, "description": F.when(number % 3 == 0, F.concat(F.lit("[sourced: x] "), "name")).otherwise(F.col("name"))})
    edges = edges.join(docs, edges.src == docs.name, "left").withColumns({"file_path": path, "description": F.lit("lives in")}).drop("name")
    back = edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "document_ids", "file_path", "description")
    dates = member.where("document_id % 5 <> 0").select(F.col("document_id").cast("string").alias("document_id"), "document_date").distinct()
    return nodes, edges.union(back.select(*edges.columns)), dates


_EDGES = "select count(distinct c_custkey) from customer where c_custkey % 4 <> 0"


@query(f"""select (select count(*) from customer) + (select count(*) from nation) as nodes_rewritten, ({_EDGES}) as edges_rewritten,
  (select count(*) from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')) + (select count(*) from nation) as entity_types_remapped""")
def post_process_report(spark, d):
    nodes, edges, _ = _described(spark, d)
    return R.post_process(nodes, edges, ["building", "machinery"])[0]


_DATED = "c_custkey in (select o_custkey from orders where o_orderkey % 5 <> 0)"


@query(f"select (select count(*) from customer where c_custkey % 3 <> 0 and {_DATED}) as nodes_annotated, ({_EDGES} and {_DATED}) as edges_annotated, true as dry_run")
def annotation_report(spark, d):
    return R.annotate(*_described(spark, d), dry_run=True)[0]
