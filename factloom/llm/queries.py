"""The queries of this subpackage's operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backtracking, bpe, filter_audit, hard_negatives, images, jaccard, kneser_ney, mixing, neighbours, quality, suffixes, token_counts, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), 4, 85)


OP1_SQL = r"""
with recursive word as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
gram as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as g
  from word, lateral (select unnest(range(1, greatest(len(w) - 2, 2))) as i) where len(w) > 0),
size as (select doc_id, count(*) as n from gram group by doc_id),
posting as (select doc_id, g, n from gram join size using (doc_id) where g in (select g from gram group by g having count(*) > 1)),
link as (
  select a.doc_id as x, b.doc_id as y from posting a join posting b on a.g = b.g and a.doc_id < b.doc_id and 85 * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edge as (select x, y from link union select y, x from link),
reach as (select doc_id as x, doc_id as y from documents union select r.x, e.y from reach r join edge e on r.y = e.x)
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.c as component_id
from documents d left join size s using (doc_id) join (select x, min(y) as c from reach group by x) r on r.x = d.doc_id
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "lang", "n_tokens", F.pow(F.lit(10.0), "log_ppl").alias("perplexity"), F.pow(F.lit(10.0), "threshold").alias("max_perplexity"), "keep")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(_table(spark, sf_dir, "documents"), 200)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_corpus(_table(spark, sf_dir, "documents"))


#: The lists of op6: entries are derived from the hosts and first path segments of the captures themselves.
LISTS = ("adult", "malware", "spam")


def url_list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for a third of the keys and lists: added on a day, perhaps removed, perhaps added again."""
    keys = pages.select(F.explode(url_filters.keys_of(F.col("url"))).alias("key")).distinct()
    rows = keys.select("key", F.explode(F.array(*map(F.lit, LISTS))).alias("list_name")).withColumn("m", F.md5(F.concat_ws("|", "key", "list_name")))
    part = lambda a, n: F.conv(F.substring("m", a, n), 16, 10).cast("int")
    rows = rows.where(part(1, 1) < 5).select("key", "list_name", (part(2, 3) % 300).alias("d1"), (part(5, 2) % 100 + 1).alias("d2"), (part(7, 2) % 100 + 1).alias("d3"), part(9, 1).alias("steps"))
    steps = F.array(
        F.struct(F.lit("add").alias("action"), F.col("d1").alias("day")),
        F.struct(F.when(F.col("steps") < 10, F.lit("remove")).alias("action"), (F.col("d1") + F.col("d2")).alias("day")),
        F.struct(F.when(F.col("steps") < 5, F.lit("add")).alias("action"), (F.col("d1") + F.col("d2") + F.col("d3")).alias("day")))
    rows = rows.select("key", "list_name", F.explode(steps).alias("e")).where("e.action is not null")
    return rows.select("list_name", "key", F.col("e.action").alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("e.day")).alias("entry_date"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 7919) % 400).cast("int")))
    rows = url_filters.evaluate(captures, url_filters.intervals(url_list_entries(pages)))
    return rows.select("page_id", F.col("fetched").cast("string").alias("fetched"), "lists", "blocked")


OP6_SQL = r"""
with parts as (
  select page_id, url, date '2024-01-01' + cast((page_id * 7919) % 400 as integer) as fetched,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$|\.+$', '')) as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*(/[^/?#]+)', 1) as segment
  from pages where url is not null),
labels_of as (select *, string_split(host, '.') as ls from parts where host <> ''),
wide as (
  select distinct page_id, url, fetched, key from (
    select page_id, url, fetched, host as key from labels_of
    union all select page_id, url, fetched, array_to_string(ls[i:], '.') from labels_of, lateral (select unnest(range(1, greatest(len(ls) - 1, 1) + 1)) as i)
    union all select page_id, url, fetched, host || segment from labels_of where segment <> '')),
hashed as (
  select key, list_name, md5(key || '|' || list_name) as m
  from (select distinct key from wide), (values ('adult'), ('malware'), ('spam')) as l(list_name)),
numbers as (
  select key, list_name, cast('0x' || substr(m, 1, 1) as integer) as pick, cast('0x' || substr(m, 2, 3) as integer) % 300 as d1,
    cast('0x' || substr(m, 5, 2) as integer) % 100 + 1 as d2, cast('0x' || substr(m, 7, 2) as integer) % 100 + 1 as d3, cast('0x' || substr(m, 9, 1) as integer) as steps
  from hashed),
active as (
  select key, list_name, d1 as a, case when steps < 10 then d1 + d2 end as b from numbers where pick < 5
  union all select key, list_name, d1 + d2 + d3, null from numbers where pick < 5 and steps < 5),
hits as (
  select page_id, url, fetched, string_agg(distinct list_name, ',' order by list_name) as lists
  from wide join active using (key)
  where fetched >= date '2024-01-01' + a and (b is null or fetched < date '2024-01-01' + b)
  group by all)
select p.page_id, cast(date '2024-01-01' + cast((p.page_id * 7919) % 400 as integer) as varchar) as fetched, coalesce(h.lists, '') as lists, h.lists is not null as blocked
from pages p left join hits h on p.page_id = h.page_id and p.url = h.url
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


OP9_SQL = r"""
with sized as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighted as (
  select source, source_size, 2.0::double * source_size as cap,
    [5.0::double, 2.0::double, 1.0::double][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)] as weight from sources),
filling as (
  select *, 1.5::double * sum(source_size) over () as total,
    coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as full_before,
    sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as weight_left
  from weighted),
levels as (select *, max(case when cap / weight >= (total - full_before) / weight_left then (total - full_before) / weight_left end) over () as level from filling),
goals as (select source, source_size, case when level is null then cap else least(cap, weight * level) end as target from levels),
ranked as (
  select s.doc_id, s.source, s.size, g.source_size, g.target,
    row_number() over (partition by s.source order by s.size, s.doc_id % 1024, s.doc_id) - 1 as rank,
    case when g.source_size > 0 then g.target / g.source_size else 0 end as rate,
    cast('0x' || substr(md5(coalesce(s.source, '') || '#0'), 1, 8) as bigint) / 4294967296.0::double as u
  from sized s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, cast(target as double) as target,
  cast((floor(u + rate * (rank + 1)) - floor(u + rate * rank)) as bigint) * size as taken
from ranked
"""


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.copies(images.media_of(_table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "image_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with words as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
judged as (
  select doc_id, part,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask
  from words),
known as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
counted as (
  select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from judged left join known using (doc_id) group by part, mask),
letter as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(l, b)),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from letter a, letter b, letter c, letter d, letter e where a.b + b.b + c.b + d.b + e.b = 31 and len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
steps as (select filter_order, step, bits[step] as f, coalesce(list_sum(bits[1 : step - 1]), 0)::int as before from orders, (select unnest(range(1, 6))::int as step)),
sums as (
  select part, filter_order, step, f,
    sum(case when mask & (f | before) = 0 then n else 0 end)::bigint as kept, sum(case when mask & f <> 0 and mask & before = 0 then n else 0 end)::bigint as removed,
    sum(case when mask & f <> 0 and mask & before <> 0 then n else 0 end)::bigint as redundant, sum(case when mask = f then n else 0 end)::bigint as unique_fails,
    sum(case when mask & f <> 0 and mask & before = 0 then good else 0 end)::bigint as good_lost, sum(case when mask & f <> 0 and mask & before = 0 then toxic else 0 end)::bigint as toxic_lost
  from counted, steps group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, f)::bigint as shapley from sums
"""


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtracking.encode_documents(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
with rows as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.r, a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
  from rows a join rows b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (
  select * from (select r, anchor_id, other_id as positive_id, score as positive_score, row_number() over (partition by r order by score desc, other_id) as place from scores where same)
  where place <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (
  select anchor_id, positive_id, other_id as negative_id, positive_score, score as negative_score,
    cast(row_number() over (partition by r, place order by score desc, other_id) as integer) as rank
  from positives join (select r, other_id, score from scores where not same) using (r)
  where 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
where rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_quality_classifier, op3_nearest_neighbours, op4_suffix_dedup, op5_lm_scoring, op6_url_filters, op7_token_counts, op8_byte_bpe, op9_source_mixing, op10_image_copies,
                                    op11_filter_audit, op12_backtracking_bpe, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op6_url_filters": OP6_SQL, "op9_source_mixing": OP9_SQL, "op11_filter_audit": OP11_SQL, "op13_hard_negatives": OP13_SQL}
