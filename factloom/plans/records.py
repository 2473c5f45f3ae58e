"""Queries of record stores, corrections, documents as they are taken in, and reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import corrections as C
from ..operators import dates
from ..operators import documents as D
from ..operators import evaluation as E
from ..operators import facts as O
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import statements as S
from ..session import fresh_path
from ..sources import records
from .queries import GRAPH, JOINED, TRANSACTIONS, _graph, _statements, query, table

TEXT = lambda c: F.col(c).cast("string")


@query("select user_id as id, max(event_id) as event_id from events where event_id % 50 <> 7 group by user_id")
def jsonl_last_line(spark, d):
    """Events as JSON lines in order, some malformed or blank; a user's last good line holds."""
    e, path = table(spark, d, "events"), fresh_path(spark, "jsonl")
    good = F.to_json(F.struct(F.col("user_id").alias("id"), "event_id"))
    line = F.when(F.col("event_id") % 50 != 7, good).when(F.col("event_id") % 100 == 7, F.lit("")).otherwise(F.concat(F.lit('{"id": 1, "event_id": '), "event_id"))
    e.select("event_id", line.alias("value")).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return records.read_jsonl(spark, path, StructType([StructField("id", LongType()), StructField("event_id", LongType())]))


@query("""with n as (select 'u' || user_id as id, count(*) as n from events where event_id % 7 = 0 group by 1), s as (select distinct 'u' || user_id as id from events where event_id % 11 = 0)
select n.id, case when s.id is not null then 'stored' else 'repeated' end as reason from n left join s on n.id = s.id where s.id is not null or n > 1""")
def append_refused(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("id"))
    return records.refused(e.where("event_id % 7 = 0").select("id"), e.where("event_id % 11 = 0").select("id"))


@query("select c_custkey as k, case when c_custkey % 3 = 0 then 'new' else c_name end as name from customer where c_custkey % 2 = 0 union all select c_custkey, 'new' from customer where c_custkey % 2 = 1 and c_custkey % 3 = 0")
def upsert_by_key(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return G.upserted(c.where("k % 2 = 0"), c.where("k % 3 = 0").withColumn("name", F.lit("new")), ["k"])


@query("""select count(*) as calls, cast(sum(o_orderkey % 1000) as bigint) as prompt_tokens, cast(sum(o_orderkey % 77) as bigint) as completion_tokens, cast(sum(o_orderkey % 300) as bigint) as cache_write, cast(sum(o_orderkey % 500) as bigint) as cache_read,
cast(sum(greatest(0, o_orderkey % 1000 - o_orderkey % 300 - o_orderkey % 500) * 4 + (o_orderkey % 300) * 5 + (o_orderkey % 500) * 1 + (o_orderkey % 77) * 20) as bigint) as cost, round(avg(o_orderkey % 13), 6) as mean_latency from orders""")
def cost_roll_up(spark, d):
    n = F.col("o_orderkey")
    calls = table(spark, d, "orders").select((n % 1000).alias("prompt_tokens"), (n % 77).alias("completion_tokens"), (n % 300).alias("cache_write"), (n % 500).alias("cache_read"), (n % 13).cast("double").alias("latency"))
    rows = E.cost_summary(calls.withColumn("cost", E.call_cost({"prompt": 4.0, "cache_write": 5.0, "cache_read": 1.0, "completion": 20.0})))
    return rows.withColumns({"cost": F.col("cost").cast("long"), "mean_latency": F.round("mean_latency", 6)})


@query("""with n as (select 'P' || p_partkey as name, case when p_partkey % 3 = 0 then 'concept' else 'part' end as t, case when p_partkey % 2 = 0 then p_brand else '' end as o from part)
select 'concept_fallback' as bucket, array_to_string(list(name order by name), ',') as names from n where t = 'concept' union all select 'remapped_singletons', array_to_string(list(name order by name), ',') from n where t = 'concept' and o <> ''""")
def type_buckets(spark, d):
    i = F.col("p_partkey")
    nodes = table(spark, d, "part").select(F.concat(F.lit("P"), i).alias("name"), F.when(i % 3 == 0, "concept").otherwise("part").alias("entity_type"), F.when(i % 2 == 0, F.col("p_brand")).otherwise("").alias("original_entity_type"))
    return G.type_buckets(nodes).select("bucket", F.array_join("names", ",").alias("names"))


@query("""with e as (select 'c' || c_custkey as src, 'n' || c_nationkey as tgt, c_custkey as k from customer where c_custkey % 5 <> 0)
select src, tgt, 'lives_in' as relation from e where k % 4 <> 0 and tgt <> 'n3'""")
def new_links(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("tgt"), "c_custkey")
    made = c.select("src", "tgt", F.lit("lives_in").alias("relation"))
    nodes = c.where("c_custkey % 5 <> 0").select(F.col("src").alias("name")).union(c.where("tgt <> 'n3'").select("tgt"))
    return S.new_edges(made.union(made), nodes, c.where("c_custkey % 4 = 0").select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))


def _doubted(spark, d):
    """Corrections that are stored for two thirds of the documents, and doubts emitted anew for half of them."""
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    doubt = lambda f: F.array(F.struct(F.lit(f).alias("field")))
    stored = docs.where("doc_id % 3 > 0").select(TEXT("doc_id").alias("document_id"), F.col("source").alias("original_filename"), F.when(n % 5 == 0, "reviewed").otherwise("pending").alias("status"), doubt("old").alias("doubts"), F.lit("mine").alias("overrides"))
    emitted = docs.where("doc_id % 2 = 0").select(TEXT("doc_id").alias("document_id"), F.col("lang").alias("original_filename"), doubt("new").alias("doubts"))
    return C.merged_doubts(stored, emitted)


_DOUBTED = """with m as (select cast(doc_id as varchar) as document_id, case when doc_id % 3 > 0 then source else lang end as original_filename, case when doc_id % 3 > 0 and doc_id % 5 = 0 then 'reviewed' else 'pending' end as status,
  case when doc_id % 2 = 0 then 'new' else 'old' end as field, case when doc_id % 3 > 0 then 'mine' end as overrides from documents where doc_id % 3 > 0 or doc_id % 2 = 0)"""


@query(_DOUBTED + " select document_id, original_filename, status, field, overrides from m")
def doubts_merged(spark, d):
    return _doubted(spark, d).select("document_id", "original_filename", "status", F.col("doubts")[0]["field"].alias("field"), "overrides")


@query(_DOUBTED + """, e as (select p_brand as bucket, count(*) as n, count(*) filter (where p_partkey % 4 = 0) as o from part group by 1)
select 'source' as layer, document_id as key, 1::bigint as n, field as about from m where status = 'pending' union all select 'entity-types', bucket, n, o || ' overridden' from e union all select 'aliases', 'g' || n_nationkey, 2, 'action=' || case when n_nationkey % 2 = 0 then 'merge' else 'accept' end from nation""")
def corrections_review(spark, d):
    entries = table(spark, d, "part").select(F.col("p_brand").alias("bucket"), F.lit("pending").alias("status"), F.when(F.col("p_partkey") % 4 == 0, "x").alias("override_type"))
    aliases = table(spark, d, "nation").select(F.concat(F.lit("g"), "n_nationkey").alias("cluster"), F.lit("pending").alias("status"), F.array("n_name", F.lit("x")).alias("members"), F.when(F.col("n_nationkey") % 2 == 0, "merge").alias("action"))
    return C.review(_doubted(spark, d), entries, aliases).select("layer", "key", "n", "about")


def _converted(spark, d):
    """Documents as a converter gives them: some texts under the body, some under a picture."""
    n = F.col("doc_id")
    text = lambda i, parent, said: F.concat(F.lit(f'{{"parent": {{"$ref": "{parent}"}}, "text": "{said}'), n.cast("string"), F.lit(f'-{i}"}}'))
    body = [F.when(n % 5 > i, text(i, "#/body", "b")) for i in range(4)]
    under = [F.when(n % 3 > 0, text(8, "#/pictures/0", "p"))]
    texts = F.concat_ws(", ", *under, *body)
    children = F.when(n % 7 == 0, "").otherwise('{"$ref": "#/texts/0"}')
    json = F.concat(F.lit('{"texts": ['), texts, F.lit('], "body": {"children": ['), children, F.lit(']}, "pictures": [{"children": []}, {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/99"}]}]}'))
    return table(spark, d, "documents").select("doc_id", F.try_parse_json(json).alias("doc"))


@query("select doc_id, case when doc_id % 5 >= 3 then 'rich' when doc_id % 7 = 0 or (doc_id % 5 = 0 and doc_id % 3 = 0) then 'empty' else 'degraded' end as quality from documents")
def doc_quality(spark, d):
    return _converted(spark, d).select("doc_id", D.extraction_quality(F.col("doc")).alias("quality"))


@query("""select doc_id, case when doc_id % 3 > 0 then '## Picture 2' || chr(10) || chr(10) || 'p' || doc_id || '-8' when doc_id % 5 > 0 then '## Picture 2' || chr(10) || chr(10) || 'b' || doc_id || '-0' else '' end as markdown from documents""")
def picture_markdown(spark, d):
    return _converted(spark, d).select("doc_id", D.fallback_markdown(F.col("doc")).alias("markdown"))


@query("""with g as (select n_regionkey as r, list('N' || n_nationkey order by n_nationkey) as m, list('N' || n_nationkey order by n_nationkey) filter (where n_nationkey % 4 <> 1) as p, list('N' || n_nationkey order by n_nationkey) filter (where n_nationkey % 4 = 1) as x from nation group by 1),
k as (select *, list_sort(list_transform(p, lambda n: (100 - length(n))::varchar || n))[1] as best from g)
select 'r' || r as cluster, case when len(p) >= 2 then substr(best, 3) end as canonical, case when len(p) >= 2 then array_to_string(list_filter(p, lambda n: n <> substr(best, 3)), ',') end as sources, case when x is not null then 'not in graph: ' || array_to_string(x, ', ') end as warning
from k where r % 2 = 0 and (len(p) >= 2 or x is not null)""")
def merge_operations(spark, d):
    n = table(spark, d, "nation").withColumn("name", F.concat(F.lit("N"), "n_nationkey"))
    members = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "name"))), lambda x: x["name"])
    aliases = n.groupBy("n_regionkey").agg(members.alias("members")).select(F.concat(F.lit("r"), "n_regionkey").alias("cluster"), "members", F.when(F.col("n_regionkey") % 2 == 0, "merge").alias("action"), F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("array<array<string>>").alias("split_groups"))
    return C.merge_operations(aliases, n.where("n_nationkey % 4 <> 1").select("name")).select("cluster", "canonical", F.array_join("sources", ",").alias("sources"), "warning")


@query("""with g as (select c_custkey as k, 'a b' || (c_custkey % 9) as s from customer), r as (select k, s, row_number() over (partition by s order by cast(k as varchar)) as n from g)
select replace(s, ' ', '_') || case when n > 1 then '_' || n else '' end as cluster, k || ' long' as other from r""")
def alias_files(spark, d):
    groups = table(spark, d, "customer").select(F.array(F.concat(F.lit("A b"), F.col("c_custkey") % 9), F.concat(TEXT("c_custkey"), F.lit(" long"))).alias("members"))
    return C.alias_corrections(groups.withColumn("members", F.reverse("members"))).select("cluster", F.col("members")[0].alias("other"))


_RAW = "case doc_id % 5 when 0 then '2024-01-0' || (doc_id % 9 + 1) when 1 then '2024-02-10T08:00:00' when 2 then '2024-02-31' when 3 then 'soon' end"


@query(f"""with r as (select doc_id, {_RAW} as raw from documents) select doc_id, case when doc_id % 5 = 0 then raw when doc_id % 5 = 1 then '2024-02-10' end as day, doc_id % 5 = 0 as birthdate from r""")
def dates_of_metadata(spark, d):
    n = F.col("doc_id")
    raw = F.when(n % 5 == 0, F.concat(F.lit("2024-01-0"), n % 9 + 1)).when(n % 5 == 1, "2024-02-10T08:00:00").when(n % 5 == 2, "2024-02-31").when(n % 5 == 3, "soon")
    return table(spark, d, "documents").select("doc_id", G.lenient_date(raw).cast("string").alias("day"), dates.valid_birthdate(raw).alias("birthdate"))


@query("select 'd' || doc_id as document_id, source || '.pdf' as original_filename, case when doc_id % 2 = 0 then '2024-01-01' end as document_date, lang || ',' || source as context from documents where doc_id % 7 > 1")
def document_maps(spark, d):
    n = F.col("doc_id")
    about = F.to_json(F.struct(F.when(n % 7 > 0, F.concat(F.lit("d"), n)).alias("document_id"), F.concat("source", F.lit(".pdf")).alias("original_filename"), F.when(n % 2 == 0, "2024-01-01").alias("document_date"), F.array("lang", "source").alias("doc_context")))
    store = table(spark, d, "documents").select(F.when(n % 7 == 1, "{broken").otherwise(about).alias("metadata"))
    return records.document_maps(store).select("document_id", "original_filename", "document_date", F.array_join("doc_context", ",").alias("context"))


@query("select 'c' || n_nationkey as case_id, n_name as question, list_sort(['doc' || n_regionkey, 'x'])[1] as first from nation")
def gold_cases(spark, d):
    path = fresh_path(spark, "cases")
    one = F.to_json(F.struct(F.collect_list(F.struct(F.concat(F.lit("c"), "n_nationkey").alias("case_id"), F.col("n_name").alias("question"), F.array(F.concat(F.lit("doc"), "n_regionkey"), F.lit("x")).alias("expected_documents"))).alias("cases")))
    table(spark, d, "nation").agg(one.alias("value")).coalesce(1).write.text(path)  # the cases of a suite are one file
    return records.read_cases(spark, path).select("case_id", "question", F.col("expected_documents")[0].alias("first"))


@query("select c_custkey as case_id, 2 - (c_custkey % 4 = 0)::int as runs, 2 as expected from customer where c_custkey % 4 = 0")
def runs_misaligned(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"))
    rows = E.misaligned(E.together(c, c.where("case_id % 4 <> 0")))
    return rows.select("case_id", F.col("runs").cast("int").alias("runs"), F.col("expected").cast("int").alias("expected"))


@query(GRAPH + " select name, degree from degree order by degree desc, name limit 40")
def top_entities(spark, d):
    return G.top_by_degree(*_graph(spark, d)[:2]).select("name", "degree")


@query(GRAPH + " select count(*) as entities, count(*) filter (where degree > 0) as with_edges, count(*) filter (where degree = 0) as isolated from degree")
def graph_isolation(spark, d):
    return G.isolation(*_graph(spark, d)[:2])


@query("select event_type as predicate, arg_max(event_id % 2 = 0, event_id) as time_varying from events group by 1")
def predicates_registered(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("predicate"), (F.col("event_id") % 2 == 0).alias("time_varying"), F.lit(False).alias("allow_multi"), F.col("event_id").alias("seq"))
    return O.registered(rows).select("predicate", "time_varying")


@query("select event_id, case event_id % 5 when 0 then 'deterministic' when 1 then 'llm_high' when 2 then 'llm_low' when 3 then 'llm_high' else 'manual' end as confidence from events")
def confidence_categories(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("1.0", "0.5", "0.49", "0.99", "manual"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", O.confidence_category(raw).alias("confidence"))


@query("select page_id, case page_id % 4 when 0 then 'text/html' when 1 then 'application/pdf' when 2 then case when page_id % 3 = 0 then 'image/png' else 'image/jpeg' end else 'application/octet-stream' end as mime, case when page_id % 4 < 3 then true else false end as supported from pages")
def page_mimes(spark, d):
    n = F.col("page_id")
    path = F.concat(F.lit("/in/p.x"), n, F.element_at(F.array(*map(F.lit, (".HTML", ".pdf", ".jpg", ".bin"))), (n % 4 + 1).cast("int")))
    sniffed = F.when((n % 4 == 2), "image/png").otherwise("application/octet-stream")
    return table(spark, d, "pages").select("page_id", D.mime_type(path, sniffed, F.when(n % 3 == 0, 0.5).otherwise(0.4)).alias("mime"), D.supported(path).alias("supported"))


@query("select doc_id, case when doc_id % 4 = 0 or doc_id % 4 = 1 or (doc_id % 4 = 2 and length(source) < 1900) then 'bank_statement' end as kind from documents")
def statement_kinds(spark, d):
    n = F.col("doc_id")
    name = F.when(n % 4 == 0, "rlv_2.pdf").when(n % 4 == 1, "Releve.pdf").otherwise("my releve.pdf")
    content = F.when(n % 4 == 2, F.concat("source", F.lit(" releve de compte "), "text")).otherwise(F.concat(F.repeat(F.lit("x"), F.lit(2000)), F.lit("RELEVE DE COMPTE")))
    return table(spark, d, "documents").select("doc_id", S.kind(name, content).alias("kind"))


@query("select doc_id, case lang when 'de' then 'DE,Fr,xx' when 'fr' then 'DE,Fr,xx' else 'DE,Fr,' || lang || ',xx' end as types from documents")
def types_united(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(D.union_of_types(F.array(F.lit("DE"), F.lit("Fr")), F.array(F.upper("lang"), F.lit("fR"), F.lit("xx"), F.lit("XX"))), ",").alias("types"))


@query("select doc_id, case when doc_id % 3 = 0 then lang || ' x' else lang end as bare, doc_id % 4 < 2 as is_index from documents")
def prefixes_stripped(spark, d):
    n = F.col("doc_id")
    text = F.when(n % 3 == 0, F.concat(F.lit(" [sourced: 2024-01-01, 2024-02-02]  "), "lang", F.lit(" x "))).otherwise(F.col("lang"))
    name = F.when(n % 4 == 0, F.concat(F.lit("Profile: "), "lang")).when(n % 4 == 1, F.concat(F.lit("Catalog: "), "lang")).otherwise(F.concat(F.lit("a Profile: "), "lang"))
    return table(spark, d, "documents").select("doc_id", G.without_source_prefix(text).alias("bare"), G.is_index_node(name).alias("is_index"))


@query("""select user_id, event_id, cast(row_number() over (partition by user_id order by event_id % 17 desc, event_id) as integer) as rank from events where event_id % 3 > 0""")
def chunks_reranked(spark, d):
    e = table(spark, d, "events")
    scores = e.where("event_id % 3 > 0").select("user_id", F.col("event_id").alias("idx"), (F.col("event_id") % 17).cast("double").alias("relevance_score"))
    gone = scores.withColumn("idx", F.col("idx") + 10**9)
    rows = R.reranked_chunks(e.select("user_id", F.col("event_id").alias("idx")), scores.union(gone), "user_id")
    return rows.select("user_id", F.col("idx").alias("event_id"), "rank")


@query("""select 'd' || doc_id as document_id, sha256(chr(10) || chr(10) || '=== /store/d' || doc_id || '/content.md (filename: ' || case when doc_id % 2 = 0 then source || '.pdf' else 'd' || doc_id end || ') ===' || chr(10) || chr(10) || coalesce(text, '')) as part from documents""")
def corpus_packed(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(".pdf"))).alias("original_filename"), F.col("text").alias("content"))
    return D.packed(docs).select("document_id", F.sha2("part", 256).alias("part"))


@query("select doc_id as document_id, case when doc_id % 3 = 0 then 'work,' || lang else 'other' end as doc_context from documents")
def documents_retagged(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.array(F.lit("other")).alias("doc_context"), "lang")
    return D.retagged(docs.drop("lang"), docs.where("document_id % 3 = 0").select("document_id", F.array(F.lit("work"), "lang").alias("tags"))).select("document_id", F.array_join("doc_context", ",").alias("doc_context"))


@query(TRANSACTIONS + """, g as (select source_doc_id, direction, category, cast(sum(amount) as decimal(38,2)) as total, count(*) as n from tx group by all)
select source_doc_id as document_id, cast(row_number() over (partition by source_doc_id order by total desc, direction, category) as integer) as at, 'Category ' || category || ' (' || direction || '): ' || total || ' EUR across ' || n || ' transactions' as line from g""")
def statement_highlights(spark, d):
    return S.summary_lines(S.transactions(_statements(spark, d)))


@query("""with t as (select doc_id, case when doc_id % 5 = 0 then 'body of ' || doc_id else text end as body, case when doc_id % 4 = 0 then ['corrected', lang] else [lang] end as tags, case when doc_id % 4 = 0 then '2023-12-31' when doc_id % 3 = 0 then '2024-05-06' end as day from documents)
select 'd' || doc_id as document_id, sha256(case when doc_id % 2 = 0 then '[EXTRACTION FOCUS: prioritize entities of these types: ' || array_to_string(tags, ', ') || '.]' || chr(10) || chr(10) else '' end
  || case when day is not null then '[DOCUMENT DATE: ' || day || ']' || chr(10) || chr(10) else '' end || replace(coalesce(body, ''), 'the', case when doc_id % 4 = 0 or doc_id % 5 = 0 then 'THE' else 'the' end)) as body, doc_id % 5 = 0 as overlaid, doc_id % 2 = 0 as focused from t""")
def extraction_prepared(spark, d):
    n = F.col("doc_id")
    docs, key = table(spark, d, "documents"), F.concat(F.lit("d"), n).alias("document_id")
    rows = docs.select(key, F.col("text").alias("content"), F.map_filter(F.create_map(F.lit("document_date"), F.when(n % 3 == 0, "2024-05-06"), F.lit("even"), (n % 2 == 0).cast("string")), lambda k, v: v.isNotNull()).alias("metadata"), F.array("lang").alias("tags"))
    fixes = docs.where("doc_id % 4 = 0 or doc_id % 5 = 0").select(
        key, F.when(n % 4 == 0, F.create_map(F.lit("document_date"), F.lit("2023-12-31"))).otherwise(F.expr("cast(map() as map<string,string>)")).alias("metadata"), F.when(n % 4 == 0, F.array(F.lit("corrected"))).alias("tags"), F.lit("").alias("replaced_by"),
        F.when(n % 5 == 0, F.concat(F.lit("p"), n)).alias("override_path"), F.array(F.struct(F.lit("the").alias("find"), F.lit("THE").alias("replace"))).alias("replacements"))
    bodies = docs.where("doc_id % 5 = 0").select(F.concat(F.lit("p"), n).alias("path"), F.concat(F.lit("body of "), n).alias("body"))
    hints = F.when(F.col("metadata")["even"] == "true", F.array_sort("tags")).otherwise(F.array().cast("array<string>"))
    return C.prepared(rows, fixes, bodies, hints).select("document_id", F.sha2("body", 256).alias("body"), "overlaid", "focused")


@query("""
with c as (select c_custkey, c_name, case c_custkey % 6 when 1 then '{}' when 2 then '{"action": "merge", "canonical": "' || c_name || '"}'
  when 3 then '{"action": "split", "split_groups": [["a", "b"], ["c"]]}' when 4 then '{"action": "drop"}' when 5 then '{"action"' end as o from customer),
j as (select c_custkey, c_name, o is not null and not json_valid(o) as broken, case when json_valid(o) then o end as o from c),
k as (select *, json_extract_string(o, '$.action') as a from j)
select cast(c_custkey as varchar) as cluster, coalesce(a, 'accept') as action, json_extract_string(o, '$.canonical') as canonical,
  cast(coalesce(json_array_length(o, '$.split_groups'), 0) as bigint) as n_groups,
  case when c_custkey % 7 = 0 then 'members' when broken then 'overrides' when a not in ('accept', 'merge', 'veto', 'split') then 'action' end as refused
from k""")
def alias_decisions(spark, d):
    """Overrides of alias corrections with their defaults, and what is refused of them."""
    n, name = F.col("c_custkey"), F.col("c_name")
    merge = F.concat(F.lit('{"action": "merge", "canonical": "'), name, F.lit('"}'))
    split = '{"action": "split", "split_groups": [["a", "b"], ["c"]]}'
    own = F.when(n % 6 == 1, "{}").when(n % 6 == 2, merge).when(n % 6 == 3, split).when(n % 6 == 4, '{"action": "drop"}').when(n % 6 == 5, '{"action"')
    members = F.when(n % 7 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(name))
    rows = table(spark, d, "customer").select(TEXT("c_custkey").alias("cluster"), members.alias("members"), F.lit("reviewed").alias("status"), own.alias("overrides"))
    return C.alias_decisions(rows).select("cluster", "action", "canonical", F.size("split_groups").cast("long").alias("n_groups"), "refused")
