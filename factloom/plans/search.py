"""Queries of retrieval through vector indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import vector_index
from .queries import query, table

STAGES = ("entities_vdb", "chunks_vdb", "relationships_vdb")


@query("""with v as (select vec_id, ['entities_vdb', 'chunks_vdb', 'relationships_vdb'][cast(vec_id % 3 as integer) + 1] as stage, embedding::double[] as e from embeddings),
asked as (select vec_id as question, embedding::double[] as e from embeddings where vec_id % 50 = 0),
hits as (select question, stage, vec_id, row_number() over (partition by question, stage order by round(list_inner_product(v.e, a.e), 6) desc, vec_id) as rank from v, asked a qualify rank <= 30),
best as (select question, 'rerank' as stage, vec_id from hits where stage = 'chunks_vdb' qualify row_number() over (partition by question order by (vec_id * 37 + question) % 101 desc, rank) <= 20),
every as (select question, stage, vec_id from hits union all select * from best),
docs as (select question, stage, 'doc' || (vec_id % 40) as d from every union select question, stage, 'doc' || (vec_id % 33) from every),
named as (select question, stage, case when cast(substr(d, 4) as int) < 30 then 'F' || substr(d, 4) || '_x.pdf' else d end as f from docs),
expected as (select question, unnest(['F' || (question % 7), 'doc3', 'F1']) as prefix from asked)
select s.stage, e.question, e.prefix, coalesce(bool_or(starts_with(f, prefix)), false) as seen
from (select distinct question, prefix from expected) e cross join (select distinct stage from every) s left join named n on n.question = e.question and n.stage = s.stage group by all""")
def retrieval_trace(spark, d):
    v = table(spark, d, "embeddings")
    doc = lambda n: F.concat(F.lit("doc"), F.col("vec_id") % n)
    records = v.select("vec_id", F.concat(doc(40), F.lit("<SEP>")).alias("document_ids"), F.lit(None).cast("string").alias("file_path"), doc(33).alias("full_doc_id"))
    stages = {s: (vector_index.build(v.where(F.col("vec_id") % 3 == i)), records) for i, s in enumerate(STAGES)}
    questions = v.where("vec_id % 50 = 0")
    asked = F.col("vec_id")
    expected = questions.select(asked.alias("question"), F.explode(F.array_distinct(F.array(F.concat(F.lit("F"), asked % 7), F.lit("doc3"), F.lit("F1")))).alias("prefix"))
    names = spark.range(30).select(F.concat(F.lit("doc"), "id").alias("document_id"), F.concat(F.lit("F"), "id", F.lit("_x.pdf")).alias("original_filename"))
    return R.trace_questions(stages, questions, (F.col("vec_id") * 37 + F.col("question_id")) % 101, expected, names)
