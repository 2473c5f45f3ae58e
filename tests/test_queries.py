import datetime
import re
import unicodedata

from factloom.operators import corrections
from factloom.plans import queries


def _bare(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_whole_texts_and_names_are_slugged(spark, tmp_path):
    texts = [None, "", "É" * 50 + " end A", "É" * 50 + " end B", "Straße  \t Ünï–code " * 20, "!!!"]
    spark.createDataFrame([(i, t, "Sourcé ") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    slug = [re.sub("[^a-z0-9]+", "_", _bare(t or "").casefold()).strip("_") or "unnamed" for t in texts]
    normal = [t if t is None else " ".join(_bare(t).casefold().split()) for t in texts]
    got = queries.FOUND["fold_slug"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.slug, r.normal, r.source) for r in got] == [(s, n, "source") for s, n in zip(slug, normal)]
    got = queries.FOUND["customer_names"](spark, str(tmp_path)).orderBy("c_custkey").collect()
    assert [(r.slug, r.normal) for r in got] == list(zip(slug, normal))


def test_every_hundredth_vector_is_searched(spark, tmp_path):
    rows = [(i, [float(i * 7 % 11), float(i % 5) - 2, float(i % 3)]) for i in range(320)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.FOUND["vector_topk_all"](spark, str(tmp_path)).orderBy("question_id", "rank").collect()
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    want = [(q, j, r + 1) for q in (0, 100, 200, 300) for r, (_, j) in enumerate(sorted((-dot(rows[q][1], v), j) for j, v in rows)[:30])]
    assert [(r.question_id, r.vec_id, r.rank) for r in got] == want
    one = queries.FOUND["vector_topk"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.vec_id, r["rank"]) for r in one] == [(j, r) for q, j, r in want if q == 0]


def test_dates_are_found_behind_words_that_a_cut_makes_disqualifying(spark, tmp_path):
    texts = ["x euxené" + "y" * n + "." for n in range(30, 40)] + ["aienré mariés né"]
    rows = [(5 * i + 2, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.FOUND["document_date"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.day for r in got} == {i: str(datetime.date(2001, 1, 1) + datetime.timedelta(i)) for i, _ in rows}


def test_documents_without_another_body_are_not_joined_by_its_path(spark):
    docs = spark.createDataFrame([(str(i), f"text {i}") for i in range(6)], "document_id string, content string")
    fixes = spark.createDataFrame([("0", "a", [("o", "0")]), ("1", "gone", None), ("2", None, [("text", "t")]), ("2", "b", [])], "document_id string, override_path string, replacements array<struct<find:string,replace:string>>")
    bodies = spark.createDataFrame([("a", "foo"), ("b", "bar")], "path string, body string")
    out = corrections.resolved_content(docs, fixes, bodies)
    assert sorted((r.document_id, r.content) for r in out.collect()) == [("0", "f00"), ("1", "text 1"), ("2", "bar"), ("2", "t 2"), ("3", "text 3"), ("4", "text 4"), ("5", "text 5")]
    first = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    assert "document_id" in first and "path" not in first
