"""The operators applied to the given tables, and the SQL of each for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corrections as C
from ..operators import dates
from ..operators import documents as D
from ..operators import evaluation as E
from ..operators import facts as O
from ..operators import graph as G
from ..operators import intervals
from ..operators import merges
from ..operators import money as M
from ..operators import predicates as P
from ..operators import retrieval as R
from ..operators import statements as S
from ..operators import vector_index
from ..session import kept

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PREDICATES = [("view", True, False), ("click", True, False), ("signup", False, False), ("purchase", False, True)]
JOINED = lambda c: F.array_join(c, "|")


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predicates(spark: SparkSession) -> DataFrame:
    # in SQL, as Spark knows how small such rows are before it plans a join
    return spark.sql("select * from values " + ", ".join(f"('{p}', {varying}, {multi})" for p, varying, multi in PREDICATES) + " as t(predicate, time_varying, allow_multi)")


def facts(spark: SparkSession, sf_dir: str, docs: int | None = None) -> DataFrame:
    """Events as facts; with ``docs`` they come from so many documents and the first of an id is kept."""
    doc = F.col("event_id") % docs if docs else F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("subject_id"), F.col("event_type").alias("predicate"),
        F.round(F.col("value") * 100).cast("long").cast("string").alias("canonical_value"), F.concat(F.lit("doc:"), doc).alias("source_doc_id"),
        F.col("ts").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    rows = O.with_fact_id(rows)
    return O.keep_first(rows, ["id"]) if docs else rows


_FACTS = """facts0 as (select event_id as seq, 'user:' || user_id as subject_id, event_type as predicate, cast(cast(round(value * 100) as bigint) as varchar) as canonical_value,
  'doc:' || {doc} as source_doc_id, cast(ts as date) as valid_from from events),
facts1 as (select *, sha256(subject_id || '|' || predicate || '|' || canonical_value || '|' || source_doc_id) as id from facts0),
facts as ({keep}),
predicates as (select * from (values ('view', true, false), ('click', true, false), ('signup', false, false), ('purchase', false, true)) t(predicate, time_varying, allow_multi)),
known as (select f.*, coalesce(time_varying, false) as time_varying, coalesce(allow_multi, false) as allow_multi from facts f left join predicates using (predicate))"""
FACTS = "with " + _FACTS.format(doc="event_id", keep="select * from facts1")
FACTS97 = "with " + _FACTS.format(doc="(event_id % 97)", keep="select * from facts1 qualify row_number() over (partition by id order by seq) = 1")
_DETECTED = """, detected as (select sha256(subject_id || '|' || predicate) as id, subject_id, predicate, list_sort(list(distinct id)) as members
  from known where not allow_multi group by subject_id, predicate having count(distinct canonical_value) > 1)"""


@query(FACTS + _DETECTED + " select id, subject_id, predicate, array_to_string(members, '|') as competing_fact_ids, 'open' as status from detected")
def conflict_detect_all(spark, d):
    return O.detect_conflicts(facts(spark, d), predicates(spark)).withColumn("competing_fact_ids", JOINED("competing_fact_ids"))


@query(FACTS + """, new as (select * from known where not allow_multi qualify row_number() over (partition by subject_id, predicate order by seq desc) = 1),
met as (select n.subject_id, n.predicate, n.id, f.id as peer from new n join facts f using (subject_id, predicate) where f.id <> n.id and f.canonical_value <> n.canonical_value)
select sha256(subject_id || '|' || predicate) as conflict_id, id as fact_id, array_to_string(list_sort(list_distinct(list_append(list(distinct peer), id))), '|') as competing_fact_ids from met group by subject_id, predicate, id""")
def conflict_incremental(spark, d):
    f = facts(spark, d)
    return O.detect_for_new(O.keep_last(f, O.GROUP), f, predicates(spark)).select("conflict_id", "fact_id", JOINED("competing_fact_ids").alias("competing_fact_ids"))


@query(FACTS + _DETECTED + """, old as (select id, subject_id, predicate, members from detected where substr(id, 1, 1) < '8'),
new as (select * from known where not allow_multi qualify row_number() over (partition by subject_id, predicate order by seq desc) = 1),
met as (select n.subject_id, n.predicate, list(distinct f.id) as peers, any_value(n.id) as own from new n join facts f using (subject_id, predicate) where f.id <> n.id and f.canonical_value <> n.canonical_value group by all),
found as (select sha256(subject_id || '|' || predicate) as id, subject_id, predicate, list_append(peers, own) as members from met)
select coalesce(o.id, f.id) as id, coalesce(o.subject_id, f.subject_id) as subject_id, coalesce(o.predicate, f.predicate) as predicate,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(o.members, []), coalesce(f.members, [])))), '|') as competing_fact_ids, case when o.id is null then 'open' else 'resolved_manually' end as status from old o full join found f on o.id = f.id""")
def conflict_upsert(spark, d):
    f, p = facts(spark, d), predicates(spark)
    stored = O.detect_conflicts(f, p).where("substring(id, 1, 1) < '8'").withColumn("status", F.lit("resolved_manually"))
    found = O.detect_for_new(O.keep_last(f, O.GROUP), f, p)
    return O.with_new_conflicts(stored, found).withColumn("competing_fact_ids", JOINED("competing_fact_ids"))


@query(FACTS + _DETECTED + """, old as (select sha256(subject_id || '|' || predicate) as id, list(distinct id) as members from known where not allow_multi and seq % 2 = 0 group by subject_id, predicate having count(distinct canonical_value) > 1)
select d.id, d.subject_id, d.predicate, array_to_string(list_sort(list_distinct(list_concat(d.members, coalesce(o.members, [])))), '|') as competing_fact_ids,
  case when o.id is not null and substr(o.id, 1, 1) < '8' then 'resolved_manually' else 'open' end as status from detected d left join old o using (id)""")
def conflict_rerun_merge(spark, d):
    f, p = facts(spark, d), predicates(spark)
    old = O.detect_conflicts(f.where("seq % 2 = 0"), p).withColumn("status", F.when(F.substring("id", 1, 1) < "8", "resolved_manually").otherwise("open"))
    return O.rerun_conflicts(O.detect_conflicts(f, p), old).withColumn("competing_fact_ids", JOINED("competing_fact_ids"))


_SUPERSEDED = """, dated as (select *, case when time_varying and not allow_multi then lead(valid_from) over (partition by subject_id, predicate order by valid_from, seq) end as nx from known),
closed as (select *, case when nx <> valid_from then cast(nx - interval 1 day as date) end as valid_to from dated)"""


@query(FACTS + _SUPERSEDED + " select id, seq, cast(valid_from as varchar) as valid_from, cast(valid_to as varchar) as valid_to from closed")
def supersede(spark, d):
    return O.supersede(facts(spark, d), predicates(spark)).select("id", "seq", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))


@query(FACTS + _SUPERSEDED + " select id, subject_id from closed where valid_from <= date '2024-01-20' and (valid_to is null or valid_to >= date '2024-01-20')")
def facts_as_of(spark, d):
    return O.as_of(O.supersede(facts(spark, d), predicates(spark)), F.lit("2024-01-20").cast("date")).select("id", "subject_id")


@query(FACTS + _SUPERSEDED + """, days as (select unnest([date '2024-01-05', date '2024-01-15', date '2024-01-25']) as day)
select cast(day as varchar) as day, predicate, count(*) as n from closed, days where valid_from <= day and (valid_to is null or valid_to >= day) group by day, predicate""")
def as_of_grid(spark, d):
    days = spark.sql("select explode(array(date '2024-01-05', date '2024-01-15', date '2024-01-25')) as day")
    rows = intervals.counts(O.supersede(facts(spark, d), predicates(spark)), days, ["predicate"])
    return rows.select(F.col("day").cast("string").alias("day"), "predicate", "n")


@query(FACTS + _SUPERSEDED + """, days as (select cast(d as date) as day from generate_series(date '2020-01-01', date '2029-12-01', interval 1 month) t(d))
select cast(day as varchar) as day, subject_id, count(*) as n from closed, days where valid_from <= day and (valid_to is null or valid_to >= day) group by day, subject_id""")
def as_of_subjects(spark, d):
    days = spark.sql("select explode(sequence(date '2020-01-01', date '2029-12-01', interval 1 month)) as day")  # ten years of months
    rows = intervals.counts(O.supersede(facts(spark, d), predicates(spark)), days, ["subject_id"])
    return rows.select(F.col("day").cast("string").alias("day"), "subject_id", "n")


def _replaced(spark, d):
    f = kept(facts(spark, d, 97))
    docs = f.select("source_doc_id").distinct()
    number = F.substring("source_doc_id", 5, 9).cast("int")
    fixes = docs.select(F.col("source_doc_id").alias("document_id"), F.when(number % 10 == 0, F.concat(F.lit("doc:"), number + 1)).alias("replaced_by"))
    dates = docs.select(F.col("source_doc_id").alias("document_id"), F.lit("2024-06-01").cast("date").alias("document_date"))
    return f, O.replacements(f, O.replacement_chains(fixes), dates, predicates(spark))


_REPLACED = """, chains as (select distinct source_doc_id as old_doc, 'doc:' || (cast(substr(source_doc_id, 5) as int) + 1) as new_doc from facts where cast(substr(source_doc_id, 5) as int) % 10 = 0),
newest as (select * from facts qualify row_number() over (partition by source_doc_id, subject_id, predicate order by seq desc) = 1),
replaced as (select k.id as old_id, n.id as new_id, k.seq, c.old_doc, case when k.time_varying then cast(n.valid_from - interval 1 day as date) end as valid_to from known k join chains c on k.source_doc_id = c.old_doc
  join newest n on n.source_doc_id = c.new_doc and n.subject_id = k.subject_id and n.predicate = k.predicate)"""


@query(FACTS97 + _REPLACED + " select old_id, new_id, cast(valid_to as varchar) as valid_to from replaced")
def replacement_chain(spark, d):
    return _replaced(spark, d)[1].select("old_id", "new_id", F.col("valid_to").cast("string").alias("valid_to"))


@query(FACTS97 + _REPLACED + " select k.id, cast(r.valid_to as varchar) as valid_to from known k left join replaced r on k.id = r.old_id")
def replacement_ends(spark, d):
    f, r = _replaced(spark, d)
    return O.with_replaced_ends(f, r).select("id", F.col("valid_to").cast("string").alias("valid_to"))


@query(FACTS97 + _DETECTED + _REPLACED + """, won as (select d.id, arg_min(r.new_id, (r.old_doc, r.seq)) as w, arg_min(r.old_id, (r.old_doc, r.seq)) as l from detected d, replaced r where list_contains(d.members, r.old_id) and list_contains(d.members, r.new_id) group by d.id)
select d.id, w as winner_fact_id, l as loser_fact_id, case when w is null then 'open' else 'resolved_temporally' end as status from detected d left join won using (id)""")
def replacement_conflicts(spark, d):
    f, r = _replaced(spark, d)
    return O.resolve_replaced(O.detect_conflicts(f, predicates(spark)), r).select("id", "resolution.winner_fact_id", "resolution.loser_fact_id", "status")


@query(FACTS + " select id, seq from facts")
def fact_ids(spark, d):
    return facts(spark, d).select("id", "seq")


@query(FACTS + " select sha256(id || '|' || source_doc_id || '|row:' || seq || '|events') as id, id as fact_id from facts")
def claim_ids(spark, d):
    return O.claims(facts(spark, d), F.concat(F.lit("row:"), "seq"), "events").select("id", "fact_id")


_CLAIMS = """, claims as (select id as fact_id, sha256(id || '|' || source_doc_id || '|row|events') as id from facts where seq % 3 <> 0)"""


def _claimed(spark, d):
    f = facts(spark, d)
    return f, O.claims(f.where("seq % 3 <> 0"), F.lit("row"), "events"), O.detect_conflicts(f, predicates(spark))


_CLAIM = lambda c: F.concat_ws("/", c["id"], c["source_doc_id"], c["source_location"], c["extractor"])
_CONFLICT = lambda c: F.concat_ws("/", c["id"], c["subject_id"], c["predicate"], c["status"])
_CLAIM_SQL = "coalesce(c.id || '/' || f.source_doc_id || '/row/events', '') as claims"


@query(FACTS + _DETECTED + _CLAIMS + f" select d.id as conflict_id, f.id as fact_id, f.canonical_value, {_CLAIM_SQL} from (select id, unnest(members) as m from detected) d join facts f on f.id = d.m left join claims c on c.fact_id = f.id")
def conflict_detail(spark, d):
    f, c, k = _claimed(spark, d)
    return O.conflict_details(k, f, c).withColumn("claims", JOINED(F.transform("claims", _CLAIM)))


@query(FACTS + _DETECTED + _CLAIMS + f""", held as (select id, subject_id || '/' || predicate || '/open' as about, unnest(members) as m from detected)
select f.id, f.canonical_value, {_CLAIM_SQL}, coalesce(h.id || '/' || h.about, '') as conflicts from facts f left join claims c on c.fact_id = f.id left join held h on h.m = f.id""")
def fact_detail(spark, d):
    return O.fact_details(*_claimed(spark, d)).select("id", "canonical_value", JOINED(F.transform("claims", _CLAIM)).alias("claims"), JOINED(F.transform("conflicts", _CONFLICT)).alias("conflicts"))


@query(FACTS + _SUPERSEDED + """, who as (select distinct 'user:' || c_custkey as entity_id from customer),
valid as (select subject_id, list_sort(list(distinct id)) as f from closed where valid_from <= date '2024-01-20' and (valid_to is null or valid_to >= date '2024-01-20') group by all)
select entity_id, coalesce(len(f), 0) as n_facts, coalesce(array_to_string(f, '|'), '') as facts from who left join valid on subject_id = entity_id""")
def entity_snapshot(spark, d):
    who = table(spark, d, "customer").select(F.concat(F.lit("user:"), "c_custkey").alias("entity_id")).distinct()
    f = O.supersede(facts(spark, d), predicates(spark))
    return O.entity_snapshot(f, who, F.lit("2024-01-20").cast("date")).withColumn("facts", JOINED("facts"))


@query(FACTS + _DETECTED + _CLAIMS + " select (select count(*) from facts) as facts, (select count(*) from claims) as claims, (select count(*) from detected) as conflicts, (select count(*) from detected) as open_conflicts")
def store_totals(spark, d):
    return O.totals(*_claimed(spark, d))


@query(FACTS + " select predicate, time_varying, allow_multi, count(*) as n from known group by all")
def predicate_contract(spark, d):
    return O.with_contract(facts(spark, d), predicates(spark)).groupBy("predicate", "time_varying", "allow_multi").agg(F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, l_linestatus, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(38,2)) as total, count(*) as n from lineitem group by all")
def spend_buckets(spark, d):
    return M.spend(table(spark, d, "lineitem").withColumn("amount", F.col("l_extendedprice").cast("decimal(18,2)")), "l_returnflag", "l_linestatus")


def _sql_category(text: str) -> str:
    cases = " ".join(f"when starts_with(t, '{p}') then '{c}'" for p, c in M.CATEGORIES)
    return f"case {cases} else 'other' end" .replace("(t,", f"({text},")


STARTS = ("  *VIR SEPA RECU ", "** carte ", "PRLV ", "virement ", "Agios ", " solde ", "x ")


@query("with o as (select o_orderkey, upper(ltrim(ltrim(ltrim(['" + "','".join(STARTS) + "'][cast(o_orderkey % 7 as integer) + 1] || o_orderpriority), '*'))) as t from orders) select o_orderkey, " + _sql_category("t") + " as category from o")
def txn_category(spark, d):
    text = F.concat(F.element_at(F.array(*map(F.lit, STARTS)), (F.col("o_orderkey") % 7 + 1).cast("int")), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", M.category(text).alias("category"))


def _statements(spark, d):
    """A statement an order: a table row a line item."""
    name = F.concat(F.lit("st-"), "l_orderkey")
    cell = lambda c: F.replace(F.format_number(c, 2), F.lit(","), F.lit(" "))
    money = F.replace(cell(F.col("l_extendedprice")), F.lit("."), F.lit(","))
    text = F.concat(F.element_at(F.array(*map(F.lit, STARTS)), (F.col("l_linenumber") % 7 + 1).cast("int")), "l_returnflag", F.lit(" "), F.col("l_linenumber").cast("string"))
    day = F.concat(F.lpad((F.col("l_linenumber") * 3 + 1).cast("string"), 2, "0"), F.when(F.col("l_linenumber") % 2 == 0, ".01").otherwise(".12"))
    line = F.concat(F.lit("| "), day, F.lit(" | "), text, F.lit(" | "), F.when(F.col("l_linenumber") % 3 > 0, day).otherwise(""), F.lit(" | "), F.when(F.col("l_linenumber") % 2 == 0, money).otherwise(""), F.lit(" | "), F.when(F.col("l_linenumber") % 2 == 1, money).otherwise(""), F.lit(" |"))
    rows = table(spark, d, "lineitem").select(name.alias("document_id"), "l_orderkey", F.struct("l_linenumber", "l_returnflag", "l_extendedprice", line.alias("line")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"])
    head = F.concat(F.lit("RELEVE DE COMPTE\nRIB : 3000 "), F.col("l_orderkey") % 100, F.lit("\ndu 1 décembre 2023 au 31 janvier 2024\n\n| Date | Nature | Valeur | Débit | Crédit |\n|---|---|---|---|---|\n"))
    return rows.groupBy("document_id", "l_orderkey").agg(lines.alias("lines")).select("document_id", F.concat(head, F.array_join("lines", "\n")).alias("content"))


TRANSACTIONS = """with t as (select 'st-' || l_orderkey as source_doc_id, l_linenumber, '3000 ' || (l_orderkey % 100) as rib, l_returnflag, trim(['""" + "','".join(STARTS) + """'][cast(l_linenumber % 7 as integer) + 1] || l_returnflag || ' ' || l_linenumber) as description,
  make_date(case when l_linenumber % 2 = 0 then 2024 else 2023 end, case when l_linenumber % 2 = 0 then 1 else 12 end, cast(l_linenumber * 3 + 1 as integer)) as day, l_linenumber % 2 = 0 as is_debit, cast(l_extendedprice as decimal(18,2)) as amount from lineitem),
u as (select *, upper(ltrim(ltrim(ltrim(description), '*'))) as t from t where not starts_with(upper(description), 'SOLDE ')),
tx as (select *, row_number() over (partition by source_doc_id order by l_linenumber, l_returnflag, amount) - 1 as row, """ + _sql_category("t") + """ as category, case when is_debit then 'debit' else 'credit' end as direction,
  'Transaction ' || case when is_debit then 'debit' else 'credit' end || ' ' || cast(amount as varchar) || ' EUR ' || cast(day as varchar) || ' ' || substr(description, 1, 60) || ' [' || substr(md5(description), 1, 4) || ']' as name from u)"""


@query(TRANSACTIONS + " select source_doc_id, cast(row as integer) as row, cast(day as varchar) as date, description, cast(amount as varchar) as amount, direction, category, rib as account_rib from tx")
def txn_from_markdown(spark, d):
    return S.transactions(_statements(spark, d)).select("source_doc_id", "row", F.col("date").cast("string").alias("date"), "description", F.col("amount").cast("string").alias("amount"), "direction", "category", "account_rib")


@query(TRANSACTIONS + """, f as (select source_doc_id, row, 'account:' || rib as subject_id, name as canonical_value, sha256('account:' || rib || '|transaction|' || name || '|' || source_doc_id) as id from tx)
select subject_id, canonical_value, id, sha256(id || '|' || source_doc_id || '|row:' || row || '|pack:bank_statement@0.3.0') as claim_id from f""")
def txn_facts(spark, d):
    return S.transaction_facts(S.transactions(_statements(spark, d))).select("subject_id", "canonical_value", "id", "claim_id")


@query(TRANSACTIONS + """, b as (select source_doc_id, direction, category, sum(amount) as total, count(*) as n from tx group by all),
n as (select 'Expense summary ' || category || ' (' || direction || ') from bank statement ' || source_doc_id as name, 'transaction_category' as entity_type, 'Bank statement aggregate: category ' || category || ' (' || direction || '/' || case direction when 'debit' then 'expense' else 'income' end || ') totalling ' || cast(cast(total as decimal(38,2)) as varchar) || ' EUR across ' || n || ' transaction(s). Source document: ' || source_doc_id || '.' as description from b
union all select name, 'transaction', min('Bank transaction on ' || cast(day as varchar) || ' (' || direction || ') of ' || cast(amount as varchar) || ' EUR, category ' || category || '. Description: ' || description || '.') from tx group by name
union all select distinct 'account:' || rib, 'account', 'account account:' || rib from tx
union all select distinct 'Document /store/' || source_doc_id || '/ (bank statement)', 'document', 'document Document /store/' || source_doc_id || '/ (bank statement)' from tx) select * from n""")
def txn_nodes(spark, d):
    return S.transaction_nodes(S.transactions(_statements(spark, d))).select("name", "entity_type", "description")


@query(TRANSACTIONS + """, e as (select name as src, 'account:' || rib as tgt, 'on_account' as relation from tx union select name, 'Document /store/' || source_doc_id || '/ (bank statement)', 'from_document' from tx
union select name, 'Expense summary ' || category || ' (' || direction || ') from bank statement ' || source_doc_id, 'in_category' from tx
union select 'Expense summary ' || category || ' (' || direction || ') from bank statement ' || source_doc_id, 'Document /store/' || source_doc_id || '/ (bank statement)', 'summary_of_document' from tx) select * from e""")
def txn_edges(spark, d):
    return S.transaction_edges(S.transactions(_statements(spark, d)))


@query("""with t as (select l_orderkey, l_linenumber, case when l_linenumber % 3 <> 0 then l_extendedprice end as debit, case when l_linenumber % 2 = 0 then l_discount end as credit, l_returnflag as description from lineitem)
select *, ((debit is null) <> (credit is null)) and coalesce(debit, credit) >= 0 and length(description) > 0 as valid, case when debit is not null then 'debit' else 'credit' end as direction, coalesce(debit, credit) as amount from t""")
def txn_validate(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice")).alias("debit"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("credit"), F.col("l_returnflag").alias("description"))
    return t.select("*", M.valid(F.col("debit"), F.col("credit"), F.col("description")).alias("valid"), M.direction(F.col("debit")).alias("direction"), M.amount(F.col("debit"), F.col("credit")).alias("amount"))


@query("select sha256(text) as hash, min(doc_id) as first, count(*) as copies from documents group by text")
def doc_dedup(spark, d):
    return D.duplicates(table(spark, d, "documents"))


@query("select doc_id, cast(row_number() over w as integer) as version, row_number() over w = count(*) over (partition by source, n_chars) as is_current from documents window w as (partition by source, n_chars order by doc_id)")
def doc_versions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "n_chars").alias("path"))
    return D.versions(docs, "path", "doc_id").select("doc_id", "version", "is_current")


PATH = "'/in/' || doc_id || ['.pdf', '.MD', '.xyz', '.html'][cast(doc_id % 4 as integer) + 1]"


@query(f"""with f as (select doc_id, {PATH} as path, doc_id % 13 > 0 as is_file, doc_id % 11 > 0 as converted, sha256(text) as hash, is_file and doc_id % 4 <> 2 as able from documents where doc_id % 5 <> 0),
stored as (select doc_id, sha256(text) as hash, '/in/' || (doc_id + 1) || ['.MD', '.xyz', '.html', '.pdf'][cast(doc_id % 4 as integer) + 1] as path from documents where doc_id % 5 = 0),
n as (select f.*, row_number() over (partition by f.hash, able and converted order by f.path) as n, h.same_hash, p.same_path from f
  left join (select hash, min(doc_id) as same_hash from stored group by hash) h on h.hash = f.hash left join (select path, min(doc_id) as same_path from stored group by path) p on p.path = f.path)
select path, case when not is_file then 'failed' when not able then 'unsupported' when same_hash is not null or (converted and n > 1) then 'duplicate' when not converted then 'unsupported' when same_path is not null then 'updated' else 'ingested' end as status from n""")
def ingest_state(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    path = lambda i: F.concat(F.lit("/in/"), i.cast("string"), F.element_at(F.array(*map(F.lit, (".pdf", ".MD", ".xyz", ".html"))), (i % 4 + 1).cast("int")))
    files = docs.where("doc_id % 5 <> 0").select(path(F.col("doc_id")).alias("path"), (F.col("doc_id") % 13 > 0).alias("is_file"), "hash", (F.col("doc_id") % 11 > 0).alias("converted"))
    stored = docs.where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("document_id"), "hash", path(F.col("doc_id") + 1).alias("path"))
    return D.ingest_states(files, stored).select("path", "status")


@query("""select doc_id, array_to_string(list_filter([case when doc_id % 2 = 1 then 'document_date:low:provide:false' end, case when quality = 0 then 'extraction_quality:medium:review:' || (doc_id % 2 = 1) when quality is null then 'extraction_quality:high:replace:false' end], lambda x: x is not null), ',') as doubts
from documents left join labels using (doc_id)""")
def doc_doubts(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    quality = F.when(F.col("quality") == 0, "degraded").when(F.col("quality").isNull(), "empty")
    found = D.doubts(quality, F.when(F.col("doc_id") % 2 == 0, F.lit("2024-01-01")))
    said = F.transform(found, lambda x: F.concat_ws(":", x["field"], x["confidence"], x["suggested_action"], x["remedy"].cast("string")))
    return rows.select("doc_id", F.array_join(said, ",").alias("doubts"))


@query("select doc_id, sha256(case when length(text) <= 6000 then text else substr(text, 1, 3000) || chr(10) || right(text, 3000) end) as window_hash from documents")
def doc_head_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(D.head_and_tail(F.col("text")), 256).alias("window_hash"))


@query(r"""with k as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\x0B\x1C-\x1F]+|[\s\x0B\x1C-\x1F]+$', '', 'g')),
  lambda x: x <> '' and not length(regexp_replace(x, '[^|\-: ]', '', 'g')) > length(x) * 0.5) as lines from documents)
select doc_id, sha256(regexp_replace(substr(array_to_string(lines, chr(10)), 1, 1500), '\n$', '')) as text_hash from k""")
def table_noise_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(D.telling_lines(F.col("text")), 256).alias("text_hash"))


@query("select doc_id, sha256(replace(replace(text, 'the', 'THE'), 'THE ', 'a ')) as text_hash from documents")
def content_overlay(spark, d):
    fixes = F.array(*(F.struct(F.lit(a).alias("find"), F.lit(b).alias("replace")) for a, b in (("the", "THE"), ("", "no"), ("THE ", "a "))))
    return table(spark, d, "documents").select("doc_id", F.sha2(D.overlaid(F.col("text"), fixes), 256).alias("text_hash"))


@query("""select doc_id, sha256(case when lang <> 'en' then '[EXTRACTION FOCUS: prioritize entities of these types: ' || lang || ', ' || source || '.]' || chr(10) || chr(10) else '' end || case when doc_id % 3 > 0 then '[DOCUMENT DATE: 2024-01-0' || (doc_id % 3) || ']' || chr(10) || chr(10) else '' end || text) as text_hash from documents""")
def extraction_headers(spark, d):
    day = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("2024-01-0"), F.col("doc_id") % 3))
    focus = F.when(F.col("lang") != "en", F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", F.sha2(D.with_headers(F.col("text"), day, focus), 256).alias("text_hash"))


TAGGED = ("identity", "cv", "healthcare", "legal", "prescription", "work", "food")
_TAGS = "['" + "','".join(TAGGED) + "'][cast(doc_id % 7 as integer) + 1], ['" + "','".join(TAGGED) + "'][cast(doc_id // 7 % 7 as integer) + 1]"


def _tags(i):
    known = F.array(*map(F.lit, TAGGED))
    return F.array(F.element_at(known, (i % 7 + 1).cast("int")), F.element_at(known, (F.floor(i / 7) % 7 + 1).cast("int")))


@query("select doc_id, " + ", ".join(f"list_has_any([{_TAGS}], {list(P.TRIGGERS[p])}) as {p}" for p in P.TRIGGERS) + " from documents")
def tag_trigger(spark, d):
    return table(spark, d, "documents").select("doc_id", *(P.triggered(_tags(F.col("doc_id")), p).alias(p) for p in P.TRIGGERS))


_FOCUS_SQL = "map {" + ", ".join(f"'{t}': {list(f)}" for t, f in D.FOCUS.items()) + "}"


@query(f"""with t as (select doc_id, list_distinct([{_TAGS}]) as x, [{_TAGS}] as tags from documents),
f as (select doc_id, flatten(list_transform(tags, lambda t: coalesce({_FOCUS_SQL}[t], []))) as types from t)
select doc_id, array_to_string(list_filter(types, lambda t, i: list_position(types, t) = i)[1:10], ',') as focus from f""")
def focus_types(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(D.focus_types(_tags(F.col("doc_id"))), ",").alias("focus"))


@query("""select doc_id, case doc_id % 4 when 3 then 'other' else 'food' || case when doc_id % 7 = 0 then ',work' else '' end end as tags, case doc_id % 4 when 3 then 'classifier response: invalid JSON' else source end as rationale from documents""")
def classifier_json(spark, d):
    item = F.concat(F.lit('{"tags": ["Food", "nothing", 7, "food"'), F.when(F.col("doc_id") % 7 == 0, ', " WORK "').otherwise(""), F.lit('], "rationale": "'), "source", F.lit('"}'))
    raw = F.when(F.col("doc_id") % 4 == 0, item).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Here: "), item, F.lit(" ok"))).otherwise("none at all")
    got = D.classified(raw)
    return table(spark, d, "documents").select("doc_id", F.array_join(got["tags"], ",").alias("tags"), got["rationale"].alias("rationale"))


_DAY = "cast(date '2001-01-01' + cast(doc_id % 7000 as integer) as varchar)"


@query(f"""select doc_id, case doc_id % 5 when 0 then {_DAY} when 1 then {_DAY} when 2 then {_DAY} when 3 then '2020-05-06' end as day from documents""")
def document_date(spark, d):
    """Dates are written into the whole texts, as these have none: announced, in the file name, alone, or disqualified."""
    docs = table(spark, d, "documents").select("doc_id", F.translate("text", "0123456789", "").alias("t"), F.date_add(F.lit("2001-01-01").cast("date"), (F.col("doc_id") % 7000).cast("int")).alias("day"))
    written = F.date_format("day", "dd/MM/yyyy")
    plain = F.regexp_replace("t", r"(?iU)\bn[ée]e?\b|date|depuis|expir|born|birth|issued|fait|married|valid", "")
    # blanks as far as is looked back: the cut before them would make a word of NOT_ISSUED of the end of another ("euxené")
    alone = F.concat(plain, F.lit(" " * dates.LOOK_BACK + " le "), written)
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Date : "), written, F.lit(" . . . . . . . . . . . . . . . . . . . . . . 01/01/2150 "), plain)).when(F.col("doc_id") % 5 == 2, alone).when(F.col("doc_id") % 5 == 3, F.concat(F.lit("née le "), written, F.lit(" " * 50 + " 6 mai 2020 "), plain)).otherwise(plain)
    name = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("scan_"), F.date_format("day", "yyyyMMdd"), F.lit(".pdf"))).otherwise("scan.pdf")
    rows = dates.with_document_date(docs.select("doc_id", text.alias("content"), name.alias("original_filename")))
    return rows.select("doc_id", F.col("document_date").cast("string").alias("day"))


@query("""with r as (select doc_id, 'entity:' || 'n' || (doc_id % 50) as s from documents where list_has_any(["""+_TAGS+"""], """+str(list(P.TRIGGERS["employer"]))+"""))
select s as subject_id, 'Acme ' || (doc_id % 9) as canonical_value, sha256(s || '|employer|Acme ' || (doc_id % 9) || '|d' || doc_id) as id, cast(date '2020-01-01' + cast(doc_id % 300 as integer) as varchar) as valid_from, 'llm_high' as confidence, 'employer:0' as source_location from r join documents using (doc_id)""")
def predicate_facts(spark, d):
    docs = table(spark, d, "documents")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string")
    about = docs.select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.lit("2019-01-01").alias("document_date"), _tags(F.col("doc_id")).alias("doc_context"))
    item = F.concat(F.lit('```json\n["x", {"employee_name": "N'), F.col("doc_id") % 50, F.lit('", "employer_name": " Acme   '), F.col("doc_id") % 9, F.lit('", "period_start_iso": "'), day, F.lit('"}, {"employee_name": ""}]\n```'))
    responses = docs.select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.lit("employer").alias("predicate"), item.alias("response"))
    new = P.run(about, responses, spark.createDataFrame([], "id string"), ("employer",))
    return new.select("subject_id", "canonical_value", "id", F.col("valid_from").cast("string").alias("valid_from"), "confidence", "source_location")


def _graph(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("c_mktsegment").alias("entity_type")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("NATION")))
    edges = c.where("c_custkey % 4 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("tgt"))
    member = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("name"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").cast("date").alias("document_date"))
    return nodes, edges, member


GRAPH = """with nodes as (select 'c' || c_custkey as name, c_mktsegment as entity_type from customer union all select 'n' || n_nationkey, 'NATION' from nation),
edges as (select distinct 'c' || c_custkey as src, 'n' || c_nationkey as tgt from customer where c_custkey % 4 <> 0),
member as (select 'c' || o_custkey as name, o_orderkey as document_id, cast(o_orderdate as date) as document_date from orders),
degree as (select n.name, n.entity_type, count(e.x) as degree from nodes n left join (select src as name, tgt as x from edges union all select tgt, src from edges) e using (name) group by all)"""


@query(GRAPH + " select entity_type, count(*) as n from nodes group by all")
def type_histogram(spark, d):
    return G.type_histogram(_graph(spark, d)[0])


@query(GRAPH + " select * from degree")
def graph_stats(spark, d):
    return G.degrees(*_graph(spark, d)[:2])


@query(GRAPH + """, a as (select entity_type, count(*) as entities, round(avg(degree), 2) as mean_degree, count(*) filter (where degree = 0) as isolated from degree group by all),
b as (select entity_type, count(distinct document_id) as documents from nodes join member using (name) group by all) select a.*, coalesce(documents, 0) as documents from a left join b using (entity_type)""")
def corpus_diag(spark, d):
    return G.diagnosis(*_graph(spark, d))


@query(GRAPH + " select name, '[sourced: ' || string_agg(distinct cast(document_date as varchar), ', ' order by cast(document_date as varchar)) || '] ' as prefix from member group by name")
def sourced_prefix(spark, d):
    return G.sourced_prefix(_graph(spark, d)[2])


@query("""with t as (select p_partkey, lower(trim(split_part(p_type, ' ', 1))) as t from part) select p_partkey, case when t in ('standard', 'small', 'economy') then t else 'concept' end as entity_type, case when t not in ('standard', 'small', 'economy') and t <> '' then t end as original from t""")
def taxonomy_normalize(spark, d):
    t, original, _ = G.normal_type(F.concat(F.lit(" "), F.upper(F.split("p_type", " ")[0])), ["Standard", "small", "ECONOMY"])
    return table(spark, d, "part").select("p_partkey", t.alias("entity_type"), original.alias("original"))


def _entities(spark, d):
    """Parts as entities of their brand, suppliers as the documents that name them."""
    member = table(spark, d, "lineitem").select("l_partkey", F.concat(F.lit("s"), "l_suppkey").alias("s")).distinct()
    ids = member.groupBy("l_partkey").agg(F.array_sort(F.collect_list("s")).alias("document_ids"))
    p = table(spark, d, "part").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("entity_type"))
    nodes = p.join(ids, p.p_partkey == ids.l_partkey).select(F.concat(F.lit("P"), "p_partkey").alias("name"), "entity_type", "document_ids")
    n = F.col("s_suppkey")
    docs = table(spark, d, "supplier").where("s_suppkey % 10 > 0").select(F.concat(F.lit("s"), n).alias("document_id"), F.when(n % 3 > 0, F.concat(F.lit("file_"), n, F.lit("-x.pdf"))).alias("original_filename"),
        F.when(n % 2 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")).cast("string")).alias("document_date"), F.when(n % 4 == 0, F.array(F.lit("work"), F.lit("legal"))).otherwise(F.array().cast("array<string>")).alias("doc_context"), F.lit("rich").alias("extraction_quality"))
    return nodes, docs


ENTITIES = """with member as (select distinct l_partkey, l_suppkey, 's' || l_suppkey as d from lineitem where l_suppkey in (select s_suppkey from supplier where s_suppkey % 10 > 0)),
docs as (select s_suppkey, 's' || s_suppkey as d, case when s_suppkey % 3 > 0 then 'file_' || s_suppkey || '-x.pdf' else '' end as fn, case when s_suppkey % 2 = 0 then cast(date '2024-01-01' + cast(s_suppkey % 300 as integer) as varchar) else '' end as day, case when s_suppkey % 4 = 0 then 'work/legal' else '' end as ctx from supplier where s_suppkey % 10 > 0),
line as (select *, array_to_string(list_filter([fn, case when day <> '' then 'date=' || day end, case when ctx <> '' then 'context=' || ctx end], lambda x: x is not null and x <> ''), ', ') as bits from docs),
ent as (select 'P' || p_partkey as name, lower(replace(p_brand, '#', '')) as entity_type, m.d, '  - /store/' || m.d || '/content.md' || case when bits <> '' then ' (' || bits || ')' else '' end as line, fn, day from member m join part on l_partkey = p_partkey join line on line.d = m.d)"""


@query(ENTITIES + """, g as (select name, entity_type, list(line order by d) as l from ent group by all having count(*) >= 2)
select 'Profile: ' || name as name, sha256('Profile of ' || name || ' (type: ' || entity_type || ').' || chr(10) || 'Appears in ' || len(l) || ' documents:' || chr(10) || array_to_string(l[1:20], chr(10)) || case when len(l) > 20 then chr(10) || '  …and ' || (len(l) - 20) || ' more.' else '' end) as description from g""")
def profile_plan(spark, d):
    return G.profile_nodes(*_entities(spark, d)).select("name", F.sha2("description", 256).alias("description"))


@query(ENTITIES + """, m as (select entity_type, name, '  - ' || name || ' [' || array_to_string(list_transform(list(d order by d)[1:8], lambda x: '/store/' || x || '/content.md'), ', ') || ']' as line from ent group by entity_type, name),
n as (select entity_type, count(distinct d) as docs from ent group by entity_type),
g as (select m.entity_type, docs, list(line order by name) as l from m join n using (entity_type) group by m.entity_type, docs having count(*) >= 3 and docs >= 3)
select 'Catalog: ' || entity_type as name, sha256('Catalog of ' || entity_type || ' entities across the corpus.' || chr(10) || len(l) || ' entities found across ' || docs || ' documents:' || chr(10) || array_to_string(l, chr(10))) as description from g""")
def catalog_plan(spark, d):
    return G.catalog_nodes(*_entities(spark, d), 3).select("name", F.sha2("description", 256).alias("description"))


@query(ENTITIES + """, k as (select d, list(distinct name order by name)[1:40] as names from ent group by d), f as (select *, case when fn = '' then 'unknown' else fn end as f from docs left join k using (d))
select 'summary-' || d as chunk_id, sha256('Document: ' || f || chr(10) || 'Filename tokens: ' || translate(f, '_-', '  ') || chr(10) || 'Document date: ' || case when day = '' then 'unknown' else day end || chr(10) || 'Document ID: ' || d || chr(10) || 'Extraction quality: rich'
  || case when ctx <> '' then chr(10) || 'Document context: ' || replace(ctx, '/', ', ') else '' end || case when names is not null then chr(10) || 'Key entities: ' || array_to_string(names, ', ') else '' end) as content from f""")
def summary_chunks(spark, d):
    nodes, docs = _entities(spark, d)
    return G.summaries(docs, nodes).select("chunk_id", F.sha2("content", 256).alias("content"))


@query(ENTITIES + """, p as (select name, array_to_string(list(distinct day order by day), ', ') as days from ent where day <> '' group by name)
select 'P' || p_partkey as name, case when days is not null and p_partkey % 3 > 0 then '[sourced: ' || days || '] ' else '' end || case when p_partkey % 3 = 0 then '[sourced: x] ' else '' end || p_name as description
from part left join p on name = 'P' || p_partkey where p_partkey in (select l_partkey from lineitem)""")
def temporal_annotation(spark, d):
    nodes, docs = _entities(spark, d)
    part = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "[sourced: x] ").otherwise(""), "p_name").alias("description"))
    return G.with_sources(nodes.join(part, "name"), G.document_dates(docs)).select("name", "description")


def _aliases(spark, d):
    """Vectors as entities of their label, with names of one word or two."""
    i = F.col("vec_id")
    name = F.concat(F.lit("É"), i % 40, F.when(i % 3 == 0, F.concat(F.lit("  x"), i % 7)).otherwise(""))
    v = table(spark, d, "embeddings").select(i.alias("id"), i.alias("key"), name.alias("name"), F.col("label").cast("string").alias("entity_type"), "embedding")
    return v, G.alias_edges(v, 0.0, None)


ALIASES = """with v as (select vec_id, label, embedding, vec_id % 40 as w, case when vec_id % 3 = 0 then vec_id % 7 end as x from embeddings),
edges as (select a.vec_id as a, b.vec_id as b, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 4) as score from v a join v b on a.label = b.label and a.w = b.w and a.vec_id < b.vec_id and (a.x is null or b.x is null or a.x = b.x)
  where round(list_inner_product(a.embedding::double[], b.embedding::double[]), 4) >= 0.0),
pairs as (select a, b from edges union all select b, a from edges),
bad as (select distinct x.a as name from pairs x join pairs y on x.a = y.a and x.b < y.b where not exists (select 1 from edges e where e.a = x.b and e.b = y.b)),
clusters as (select v.vec_id as name, least(v.vec_id, coalesce(min(s.b), v.vec_id)) as cluster from embeddings v left join (select * from pairs where a not in (select name from bad) and b not in (select name from bad)) s on s.a = v.vec_id group by v.vec_id)"""


@query(ALIASES + " select * from edges")
def alias_edges(spark, d):
    return _aliases(spark, d)[1]


@query(ALIASES + " select * from bad")
def alias_ambiguous(spark, d):
    return G.ambiguous(_aliases(spark, d)[1])


@query(ALIASES + " select distinct array_to_string(list_sort(list_append(list(b), a)), '|') as members from pairs where a in (select name from bad) group by a")
def alias_groups(spark, d):
    return G.ambiguous_groups(_aliases(spark, d)[1]).select(JOINED(F.col("members").cast("array<string>")).alias("members"))


@query(ALIASES + " select * from clusters")
def alias_clusters(spark, d):
    v, e = _aliases(spark, d)
    return G.alias_clusters(v.select(F.col("id").alias("name")), e)


@query(ALIASES + """, n as (select vec_id, 'k' || vec_id as name, label, ['d' || (vec_id % 7), 'd' || (vec_id % 11)] as docs from embeddings),
c as (select n.*, cluster, row_number() over (partition by cluster order by length(n.name) desc, n.name) as r from n join clusters on clusters.name = vec_id),
m as (select *, first_value(name) over (partition by cluster order by r) as canonical from c)
select canonical as name, cast(arg_min(label, r) as varchar) as entity_type, array_to_string(list_sort(list_distinct(flatten(list(docs)))), ',') as document_ids, count(*) as members from m group by canonical""")
def apply_merge(spark, d):
    v, e = _aliases(spark, d)
    key = F.concat(F.lit("k"), "id")
    nodes = v.select("id", key.alias("name"), "entity_type", F.lit(None).cast("string").alias("description"), F.array(F.concat(F.lit("d"), F.col("id") % 7), F.concat(F.lit("d"), F.col("id") % 11)).alias("document_ids"))
    clusters = G.alias_clusters(v.select(F.col("id").alias("name")), e).select(F.concat(F.lit("k"), "name").alias("name"), "cluster")
    nodes = nodes.drop("id")
    return merges.merged(nodes, merges.moves(nodes, G.merge_plan(clusters))).select("name", "entity_type", F.array_join(F.array_sort("document_ids"), ",").alias("document_ids"), "members")


@query("""with o as (select p_partkey as name, p_brand as bucket, p_type as new_type from part where p_partkey % 3 = 0 union all select p_partkey * 2, p_brand || 'z', 'steel' from part where p_partkey % 3 = 1),
l as (select * from o qualify row_number() over (partition by name order by bucket desc) = 1)
select l.name, p.p_type as old_type, new_type, case when p.p_type is null then 'missing' when p.p_type = new_type then 'skip' else 'change' end as outcome from l left join part p on l.name = p.p_partkey""")
def type_overrides(spark, d):
    p = table(spark, d, "part")
    overrides = p.where("p_partkey % 3 = 0").selectExpr("p_partkey name", "p_brand bucket", "p_type new_type").union(p.where("p_partkey % 3 = 1").selectExpr("p_partkey * 2", "p_brand || 'z'", "'steel'"))
    return G.type_changes(p.selectExpr("p_partkey name", "p_type entity_type"), overrides)


@query("select vec_id, round(list_inner_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score, cast(row_number() over (order by round(list_inner_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) desc, vec_id) as integer) as rank from embeddings qualify rank <= 30")
def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    return R.top_k(v, v.where("vec_id = 0"), 30).select("vec_id", "score", "rank")


@query("""with s as (select q.vec_id as question_id, e.vec_id, round(list_inner_product(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id % 100 = 0)
select *, cast(row_number() over (partition by question_id order by score desc, vec_id) as integer) as rank from s qualify rank <= 30""")
def vector_topk_all(spark, d):
    v = table(spark, d, "embeddings")
    return vector_index.search(vector_index.build(v), v.where("vec_id % 100 = 0"), 30)


@query("select user_id, event_id, cast(row_number() over (partition by user_id order by value desc, event_id) as integer) as rank from events qualify rank <= 20")
def rerank_stable(spark, d):
    hits = table(spark, d, "events").select("user_id", F.col("event_id").alias("idx"), "value")
    return R.rerank(hits, F.col("value"), "user_id", 20).select("user_id", F.col("idx").alias("event_id"), "rank")


@query("""with h as (select user_id as q, event_type || '_' || event_id || '.pdf' as file_name from events where event_id % 3 = 0), e as (select distinct user_id as question, event_type || '_' || (user_id % 10) as prefix from events)
select question, prefix, bool_or(file_name is not null) as seen from e left join h on question = q and starts_with(file_name, prefix) group by all""")
def retention_trace(spark, d):
    e = table(spark, d, "events")
    hits = e.where("event_id % 3 = 0").selectExpr("user_id q", "event_type || '_' || event_id || '.pdf' file_name")
    return R.retained(hits, e.selectExpr("user_id question", "event_type || '_' || (user_id % 10) prefix").distinct())


_UUID = "substr({0},1,8)||'-'||substr({0},9,4)||'-4'||substr({0},14,3)||'-a'||substr({0},18,3)||'-'||substr({0},21,12)"


def _uuid(h):
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _paths(spark, d):
    return table(spark, d, "pages").select("page_id", _uuid(F.md5("url")).alias("a"), _uuid(F.md5((F.col("page_id") % 10).cast("string"))).alias("b"))


@query("with t as (select page_id, md5(url) as a, md5(cast(page_id % 10 as varchar)) as b from pages) select page_id, " + _UUID.format("a") + " || '|' || " + _UUID.format("b") + " as ids from t")
def doc_refs(spark, d):
    a, b = F.col("a"), F.col("b")
    text = F.concat(F.lit("see /store/"), a, F.lit("/content.md and bookstore/"), F.reverse(a), F.lit("/, /x/store/"), b, F.lit("/content.md<SEP>/store/"), a, F.lit("/content.md or /store/"), F.md5(a), F.lit("/"))
    return _paths(spark, d).select("page_id", JOINED(R.document_ids(text)).alias("ids"))


@query("with t as (select page_id, md5(url) as h, md5(cast(page_id % 10 as varchar)) as g from pages), u as (select page_id, " + _UUID.format("h") + " as a, " + _UUID.format("g") + """ as b from t)
select page_id, 'Answer [1].' || chr(10) || chr(10) || '### References' || chr(10) || chr(10) || '- [1] /store/' || a || '/content.md' || chr(10) || '- [4] notes.txt' || case when a <> b then chr(10) || '- [6] /store/' || b || '/content.md' else '' end as answer from u""")
def refs_merge(spark, d):
    ref = lambda i, p: F.struct(F.lit(i).alias("reference_id"), p.alias("file_path"))
    own = F.concat(F.lit("/data/store/"), "a", F.lit("/content.md"))
    raw = F.array(ref("1", own), ref("1", own), ref("", own), ref(" 4", F.lit("notes.txt")))
    seen = F.array(F.struct(F.lit("Profile: x").alias("entity_name"), F.concat(F.lit("/store/"), "a", F.lit("/content.md /store/"), "b", F.lit("/content.md")).alias("description")), F.struct(F.lit("Zoe").alias("entity_name"), F.lit("/store/x/").alias("description")))
    rows = _paths(spark, d).select("page_id", R.expanded_references(R.parsed_references(raw), seen).alias("refs"))
    return rows.select("page_id", R.with_references(F.lit("Answer [1].\n\n## references\n- [1] wrong"), F.col("refs")).alias("answer"))


@query("select p_partkey, case when p_partkey % 4 = 3 then false else length(trim(p_name)) > 0 end as equal from part")
def lexical_equivalent(spark, d):
    first = F.split("p_name", " ")[0]
    other = F.when(F.col("p_partkey") % 4 == 0, F.upper(F.concat("p_name", F.lit(" x")))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" É "), "p_name")).when(F.col("p_partkey") % 4 == 2, first).otherwise("another")
    return table(spark, d, "part").select("p_partkey", T.lexically_equal(first, other).alias("equal"))


_BARE = "strip_accents(lower(trim(coalesce(text, ''))))"


@query(f"""select conv_id, turn, (case when contains({_BARE}, 'the') or contains({_BARE}, 'les') then 1 else 0 end + case when contains({_BARE}, 'zz') then 1 else 0 end) / 2.0::double as covered,
case when contains({_BARE}, 'an') or contains({_BARE}, 'qq') then 1 else 0 end as forbidden, case when turn % 2 = 0 then 1.0::double when contains({_BARE}, 'no') then 1.0::double else 0.0::double end as abstained from conversations""")
def coverage_score(spark, d):
    c = table(spark, d, "conversations")
    t = F.col("text")
    return c.select("conv_id", "turn", E.coverage(t, F.array(F.lit("Thé|les|"), F.lit("zz"), F.lit(" "))).alias("covered"), E.forbidden(t, F.array(F.lit("Àn|qq"), F.lit(""))).alias("forbidden"), E.abstention(t, F.col("turn") % 2 == 1, ("no",)).alias("abstained"))


def _scored(spark, d):
    """Turns as answers to cases, against fixed expectations."""
    c = table(spark, d, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("case_id"), F.col("text").alias("answer"), "turn")
    some, none = (lambda *x: F.array(*map(F.lit, x))), F.array().cast("array<string>")
    return E.score_cases(c.select("case_id", "answer", "turn", F.array("case_id").alias("document_ids"), some("1", "2").alias("expected_documents"), some("the|les").alias("expected_entities"), some("an", "e").alias("expected_facts"),
                                  none.alias("expected_provenance"), none.alias("expected_conflicts"), some("in").alias("expected_temporal"), (F.col("turn") == 3).alias("expects_abstention"), some("zzz").alias("forbidden_facts")))


SCORED = f"""with c as (select conv_id || '-' || turn as case_id, turn, {_BARE} as t from conversations),
s as (select *, ((case when starts_with(case_id, '1') then 1 else 0 end) + (case when starts_with(case_id, '2') then 1 else 0 end)) / 2.0::double as doc, case when contains(t, 'the') or contains(t, 'les') then 1.0::double else 0.0 end as ent,
  ((case when contains(t, 'an') then 1 else 0 end) + (case when contains(t, 'e') then 1 else 0 end)) / 2.0::double as fac, case when contains(t, 'in') then 1.0::double else 0.0 end as tem,
  case when turn <> 3 or regexp_matches(t, '{"|".join(E.ABSTENTION_MARKERS).replace("'", "''")}') then 1.0::double else 0.0 end as abst, case when contains(t, 'zzz') then 1 else 0 end as bad from c)"""


@query(SCORED + " select case_id, doc as doc_coverage, ent as entity_coverage, fac as fact_coverage, tem as temporal_accuracy, abst as abstention_accuracy, bad as forbidden_violations, doc = 1 and ent = 1 and fac = 1 and tem = 1 and abst = 1 and bad = 0 as passed from s")
def case_scores(spark, d):
    return _scored(spark, d).select("case_id", "doc_coverage", "entity_coverage", "fact_coverage", "temporal_accuracy", "abstention_accuracy", "forbidden_violations", "passed")


@query(SCORED + " select count(*) as cases, count(*) filter (where doc = 1 and ent = 1 and fac = 1 and tem = 1 and abst = 1 and bad = 0) as passed, round(avg(doc), 6) as mean_doc_coverage, round(avg(fac), 6) as mean_fact_coverage, cast(sum(bad) as bigint) as total_forbidden_violations from s")
def suite_summary(spark, d):
    rows = E.summary(_scored(spark, d))
    return rows.select("cases", "passed", F.round("mean_doc_coverage", 6).alias("mean_doc_coverage"), F.round("mean_fact_coverage", 6).alias("mean_fact_coverage"), "total_forbidden_violations")


@query(SCORED + """, b as (select *, case turn % 4 when 0 then 'phase8' when 1 then 'fact-level' when 2 then 'phase8b6' else 'baseline' end as bucket from s),
m as (select bucket, 'fact_provenance_coverage' as metric, 1.0::double as v, 0.80 as floor from b where bucket = 'fact-level' union all select bucket, 'temporal_accuracy', tem, 0.80 from b where bucket = 'phase8' union all select bucket, 'abstention_accuracy', abst, 0.75 from b where bucket = 'phase8b6'
  union all select bucket, 'doc_coverage', doc, 0.65 from b where bucket = 'baseline' union all select bucket, 'entity_coverage', ent, 0.85 from b where bucket = 'baseline' union all select bucket, 'fact_coverage', fac, 0.80 from b where bucket = 'baseline')
select bucket, metric, round(avg(v), 6) as mean, avg(v) >= floor as ok from m group by bucket, metric, floor""")
def phase_gate(spark, d):
    rows = _scored(spark, d)
    tag = F.element_at(F.array(F.array(F.lit("x"), F.lit("phase8")), F.array(F.lit("phase8"), F.lit("fact-level")), F.array(F.lit("phase8b6")), F.array(F.lit("none"))), (F.col("turn") % 4 + 1).cast("int"))
    return E.gate(E.with_bucket(rows, rows.select("case_id", tag.alias("tags")))).select("bucket", "metric", F.round("mean", 6).alias("mean"), "ok")


@query("""with c as (select o_custkey, o_orderkey from orders),
k as (select o_custkey, o_orderkey, greatest(0, o_orderkey % 1000 - o_orderkey % 300 - o_orderkey % 500) * 5e-6 + (o_orderkey % 300) * 6.25e-6 + (o_orderkey % 500) * 0.5e-6 + (o_orderkey % 77) * 25e-6 as cost from c),
b as (select *, coalesce(sum(cost) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as before from k)
select o_custkey, count(*) as calls, round(sum(cost), 8) as cost from b where before < 0.02 group by o_custkey""")
def cost_budget(spark, d):
    n = F.col("o_orderkey")
    calls = table(spark, d, "orders").select("o_custkey", n, (n % 1000).alias("prompt_tokens"), (n % 77).alias("completion_tokens"), (n % 300).alias("cache_write"), (n % 500).alias("cache_read"))
    priced = calls.withColumn("cost", E.call_cost({"prompt": 5e-6, "cache_write": 6.25e-6, "cache_read": 0.5e-6, "completion": 25e-6}))
    return E.within_budget(priced, 0.02, "o_orderkey", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 8).alias("cost"))


@query("""with k as (select o_orderkey, o_orderkey % 1000 + 1 as cost from orders), r as (select *, coalesce(sum(cost) over (order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as spent from k)
select o_orderkey, cast(spent as bigint) as spent_before from r where spent < (select sum(cost) // 2 from k)""")
def budget_over_all(spark, d):
    calls = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000 + 1).alias("cost"))
    half = calls.agg(F.sum("cost")).head()[0] // 2
    return E.within_budget(calls, half, "o_orderkey").select("o_orderkey", F.col("spent_before").cast("long").alias("spent_before"))


def _source_corrections(spark, d):
    n = F.col("doc_id")
    docs = table(spark, d, "documents")
    fixes = docs.where("doc_id % 3 = 0").select(
        n.cast("string").alias("document_id"), F.create_map(F.lit("lang"), F.lit("xx"), F.lit("k"), F.col("source")).alias("metadata"), F.array(F.col("lang"), F.lit("new")).alias("tags"), F.when(n % 2 == 0, F.lit("other")).alias("replaced_by"),
        F.when(n % 9 == 0, "p0").alias("override_path"), F.array(F.struct(F.lit("the").alias("find"), F.lit("THE").alias("replace"))).alias("replacements"))
    return docs, fixes


@query("""select doc_id, case when doc_id % 3 = 0 then 'xx' else lang end as lang, coalesce(case when doc_id % 3 = 0 then source end, '') as k, lang || case when doc_id % 3 = 0 then ',new' else '' end as tags, case when doc_id % 6 = 0 then 'other' end as replaced_by from documents""")
def metadata_overlay(spark, d):
    docs, fixes = _source_corrections(spark, d)
    rows = docs.select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), F.array("lang").alias("tags"))
    out = C.with_metadata_overlay(rows, fixes)
    return out.select("doc_id", F.col("metadata")["lang"].alias("lang"), F.coalesce(F.try_element_at("metadata", F.lit("k")), F.lit("")).alias("k"), F.array_join("tags", ",").alias("tags"), "replaced_by")


@query("select doc_id, sha256(case when doc_id % 9 = 0 then replace('the other body', 'the', 'THE') when doc_id % 3 = 0 then replace(text, 'the', 'THE') else text end) as content from documents")
def content_resolution(spark, d):
    docs, fixes = _source_corrections(spark, d)
    bodies = docs.where("doc_id = 0").select(F.lit("p0").alias("path"), F.lit("the other body").alias("body"))
    out = C.resolved_content(docs.select("doc_id", F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content")), fixes, bodies)
    return out.select("doc_id", F.sha2("content", 256).alias("content"))


@query(FACTS + _DETECTED + """ select id, case when subject_id not like '%7' then 'open' when predicate = 'view' then 'resolved_temporally' else 'resolved_manually' end as status from detected""")
def conflict_decisions(spark, d):
    k = O.detect_conflicts(facts(spark, d), predicates(spark))
    made = k.where("subject_id like '%7'").select(F.col("id").alias("conflict_id"), F.lit("reviewed").alias("status"), F.col("competing_fact_ids")[0].alias("winner"), F.lit(False).alias("coexist"), F.when(F.col("predicate") == "view", F.col("competing_fact_ids")).alias("temporal_supersede_order"))
    return C.resolved_conflicts(k, made).select("id", "status")


@query("""with s as (select 'source' as layer, case when doc_id % 5 = 0 then 'reviewed' else 'pending' end as status, 1 as n from documents), e as (select 'entity-types', 'pending', count(*) from part group by p_brand),
a as (select 'aliases', case when c_custkey % 3 = 0 then 'reviewed' else 'pending' end, 2 from customer), r as (select * from s union all select * from e union all select * from a)
select layer, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'reviewed') as reviewed, cast(sum(n) as bigint) as entries from r group by layer""")
def correction_stats(spark, d):
    sources = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.when(F.col("doc_id") % 5 == 0, "reviewed").otherwise("pending").alias("status"), F.array(F.struct(F.lit("document_date").alias("field"))).alias("doubts"))
    entries = table(spark, d, "part").select(F.col("p_brand").alias("bucket"), F.lit("pending").alias("status"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("override_type"))
    aliases = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cluster"), F.when(F.col("c_custkey") % 3 == 0, "reviewed").otherwise("pending").alias("status"), F.array("c_name", "c_mktsegment").alias("members"), F.lit(None).cast("string").alias("action"))
    return C.stats(C.review(sources, entries, aliases, True))


@query("select source as case_id, count(*) as runs, round(avg(quality), 6) as quality_mean, round(stddev_pop(quality), 6) as quality_std, round(avg(case when toxic = 0 then 1.0 else 0.0 end), 6) as pass_rate from labels join documents using (doc_id) group by all")
def eval_aggregate(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("case_id")), "doc_id").withColumn("passed", F.col("toxic") == 0)
    return E.aggregate_runs(r, ["quality"]).select("case_id", "runs", *(F.round(c, 6).alias(c) for c in ("quality_mean", "quality_std", "pass_rate")))


@query("select event_id, '{\"k\":' || cast(props->>'$.k' as varchar) || '}' as objects from events")
def llm_json_parse(spark, d):
    raw = F.concat(F.lit("```json\n[\"s\", 42, "), "props", F.lit(", null]\n```"))
    return table(spark, d, "events").select("event_id", JOINED(T.json_objects(raw)).alias("objects"))


_BARE_SQL = "lower(strip_accents(replace({0}, 'ß', 'ss')))"
_SLUG_SQL = "coalesce(nullif(trim(regexp_replace(" + _BARE_SQL + ", '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed')"
_NORMAL_SQL = r"trim(regexp_replace(" + _BARE_SQL + r", '\s+', ' ', 'g'))"


@query("select doc_id, " + _SLUG_SQL.format("coalesce(text, '')") + " as slug, " + _NORMAL_SQL.format("text") + " as normal, " + _SLUG_SQL.format("coalesce(source, '')") + " as source from documents")
def fold_slug(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug("text").alias("slug"), T.fold("source").alias("source"), T.normal_name("text").alias("normal"))


@query("select c_custkey, " + _SLUG_SQL.format("coalesce(c_name, '')") + " as slug, " + _NORMAL_SQL.format("c_name") + " as normal, trim(" + _BARE_SQL.format("c_name") + ") as folded from customer")
def customer_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.slug("c_name").alias("slug"), T.fold("c_name").alias("folded"), T.normal_name("c_name").alias("normal"))
