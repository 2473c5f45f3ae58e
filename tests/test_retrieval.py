import pytest
from pyspark.sql import functions as F

from factloom.operators import retrieval as R

from .helpers import one

A, B = "5905ca2e-0000-4000-8000-000000000001", "5905ca2e-0000-4000-9000-00000000000b"


@pytest.mark.parametrize("text,ids", [
    (f"see /store/{A}/content.md<SEP>/x/store/{B}/content.md and /store/{A}/", [A, B]), (f"store/{A}/x", [A]), (f"bookstore/{A}/x", []), (f"/store/{A} x", []),
    (f"/store/sub/{A}/", []), (f"x store/{A}/", []), ("/store/5905ca2e-0000-1000-8000-000000000001/", []), ("", []), (None, []),
])
def test_document_ids(spark, text, ids):
    assert one(spark, R.document_ids(F.lit(text).cast("string"))) == ids


def test_rerank_is_stable_and_cut(spark):
    hits = spark.createDataFrame([("q", 0, 1.0), ("q", 1, 3.0), ("q", 2, 3.0), ("q", 3, 0.0)], "q string, idx int, s double")
    order = lambda top: [r.idx for r in R.rerank(hits, F.col("s"), "q", top).orderBy("rank").collect()]
    assert order(None) == order(-1) == [1, 2, 0, 3] and order(2) == [1, 2] and order(0) == []
    scores = spark.createDataFrame([("q", 2, 9.0), ("q", 0, 8.0), ("q", 77, 10.0)], "q string, idx int, relevance_score double")
    assert [r.idx for r in R.reranked_chunks(hits, scores, "q").orderBy("rank").collect()] == [2, 0]


def test_documents_of_hits_and_trace(spark):
    got = one(spark, R.hit_documents(F.lit(f"{A}<SEP>x"), F.lit(f"/store/{B}/content.md"), F.lit("c")))
    assert got == [A, "x", B, f"/store/{B}/content.md", "c"]
    names = spark.createDataFrame([(A, "école.pdf")], "document_id string, original_filename string")
    hits = spark.createDataFrame([("q", A), ("q", B)], "question string, document_id string")
    expected = spark.createDataFrame([("q", "école"), ("q", B[:8]), ("q", "zz")], "question string, prefix string")
    rows = R.trace({"entities": hits, "rerank": hits.where("document_id = 'none'")}, expected, names).collect()
    assert {(r.stage, r.prefix) for r in rows if r.seen} == {("entities", "école"), ("entities", B[:8])} and len(rows) == 6


REF = "array<struct<reference_id:string,file_path:string>>"


def answer(spark, text, refs, entities=()):
    df = spark.createDataFrame([(text, refs, list(entities))], f"a string, r {REF}, e array<struct<entity_name:string,description:string>>")
    rows = df.select("a", R.expanded_references(R.parsed_references(F.col("r")), F.col("e")).alias("x"))
    return rows.select("x", R.with_references(F.col("a"), F.col("x")).alias("t")).first()


def test_references(spark):
    refs = [("1", f"/abs/store/{A}/content.md"), ("1", f"/abs/store/{A}/content.md"), ("", "x"), ("2", None), (" 7 ", "notes.txt"), ("x", "y.txt")]
    index = [("Profile: Zoe", f"- /store/{A}/content.md - /store/{B}/content.md"), ("Other", f"/store/{B}/"), ("Catalog: t", f"/store/{B}/")]
    got = answer(spark, "Text [1].\n\n### references\n\n- [1] wrong\n", refs, index)
    assert [(r.reference_id, r.doc_id) for r in got.x] == [("1", A), ("7", None), ("x", None), ("9", B)]
    want = f"Text [1].\n\n### References\n\n- [1] /store/{A}/content.md\n- [7] notes.txt\n- [x] y.txt\n- [9] /store/{B}/content.md"
    assert got.t == want
    again = answer(spark, got.t, refs, index)
    assert again.t == want
    assert answer(spark, "Text\n## References\n- old", []).t == "Text"
    assert answer(spark, None, None).t == ""
