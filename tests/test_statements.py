import datetime
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.operators import money as M
from factloom.operators import statements as S

from .helpers import one

DAY = datetime.date
TEXT = """RELEVE DE COMPTE
RIB : 30004 00123  00001234567 89 IBAN FR76
du 15 décembre 2023 au 14 janvier 2024

| Date | Nature | Valeur | Débit | Crédit |
|------|:------|---|---|---|
| 20.12 | VIR SEPA RECU DUPONT | 21.12 | | 1 209,10 |
| 03.01 | CARTE X | | 12,50 | |
| 04.01 | SOLDE AU 04.01 | 04.01 | 1,00 | |
| 05.01 | BOTH | 05.01 | 1,00 | 2,00 |
| 32.01 | BAD DAY | 05.01 | 1,00 | |
| 06.01 | NOTHING | 05.01 | x | |
| 06.01 | | 05.01 | 1,00 | |
| 07.01 | SHORT |
| Date | Nature | Valeur | Débit | Crédit |
| 08.01 | * FRAIS DE TENUE | 08.01 | 3,20 | |
outside
| 09.01 | NO HEADER | 09.01 | 1,00 | |
"""
DOCS = [("d1", TEXT), ("d2", TEXT.replace("du 15", "de 15")), ("d3", None), ("d4", TEXT.replace("RIB", "RIP").replace("décembre 2023", "janvier 2024"))]


@pytest.fixture(scope="module")
def rows(spark):
    return S.transactions(spark.createDataFrame(DOCS, "document_id string, content string")).cache()


def test_rows_of_tables_become_transactions(rows):
    got = [tuple(r) for r in rows.where("source_doc_id = 'd1'").orderBy("row").collect()]
    number = "30004 00123 00001234567 89"
    assert got == [
        ("d1", 0, DAY(2023, 12, 20), DAY(2023, 12, 21), "VIR SEPA RECU DUPONT", None, Decimal("1209.10"), Decimal("1209.10"), "credit", "transfer_in", number),
        ("d1", 1, DAY(2024, 1, 3), DAY(2024, 1, 3), "CARTE X", Decimal("12.50"), None, Decimal("12.50"), "debit", "card_payment", number),
        ("d1", 2, DAY(2024, 1, 8), DAY(2024, 1, 8), "* FRAIS DE TENUE", Decimal("3.20"), None, Decimal("3.20"), "debit", "fee", number),
    ]
    assert rows.where("source_doc_id in ('d2', 'd3')").count() == 0
    assert {r.account_rib for r in rows.where("source_doc_id = 'd4'").collect()} == {None}


def test_facts_nodes_and_edges(rows):
    facts = S.transaction_facts(rows.where("source_doc_id = 'd1'")).orderBy("source_location").collect()
    name = f"Transaction debit 12.50 EUR 2024-01-03 CARTE X [{hashlib.md5(b'CARTE X').hexdigest()[:4]}]"
    assert facts[1].canonical_value == name and facts[1].subject_id == "account:30004 00123 00001234567 89" and facts[1].source_location == "row:1"
    assert facts[1].id == hashlib.sha256("|".join([facts[1].subject_id, "transaction", name, "d1"]).encode()).hexdigest()
    nodes = {r.name: r for r in S.transaction_nodes(rows).collect()}
    assert {r.entity_type for r in nodes.values()} == {"transaction", "transaction_category", "account", "document"}
    assert "account:unknown" in nodes and "Document /store/d1/ (bank statement)" in nodes
    said = nodes["Expense summary fee (debit) from bank statement d1"].description
    assert said == "Bank statement aggregate: category fee (debit/expense) totalling 3.20 EUR across 1 transaction(s). Source document: d1."
    edges = {tuple(r) for r in S.transaction_edges(rows).collect()}
    assert (name, "Document /store/d1/ (bank statement)", "from_document") in edges and len(edges) == 2 * 3 * 3 + 2 * 3


def test_edges_that_are_there_or_lack_an_end_are_not_made(spark):
    made = lambda r: spark.createDataFrame(r, "src string, tgt string, relation string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    got = S.new_edges(made([("a", "b", "x"), ("b", "c", "y"), ("c", "b", "z"), ("a", "q", "x")]), nodes, made([("b", "a", "old")]).select("src", "tgt"))
    assert [tuple(r) for r in got.collect()] == [("b", "c", "y")]


def test_highlights_are_in_order_of_their_totals(rows):
    got = [r.line for r in S.summary_lines(rows.where("source_doc_id = 'd1'")).orderBy("at").collect()]
    assert got[0] == "Category transfer_in (credit): 1209.10 EUR across 1 transactions" and len(got) == 3


@pytest.mark.parametrize("raw,value", [("1 209,10", "1209.10"), (" 12,5 ", "12.50"), ("1 000", "1000.00"), ("-3,00", "-3.00"), ("", None), ("abc", None), ("1,2,3", None)])
def test_french_numbers(spark, raw, value):
    assert one(spark, M.french_number(F.lit(raw))) == (value and Decimal(value))


@pytest.mark.parametrize("text,category", [("  * VIR SCT INST RECU /X", "transfer_in"), ("VIR SEPA", "transfer_out"), ("virement", "transfer_out"), ("** carte 12", "card_payment"), ("AGIOS", "fee"), ("X VIR", "other"), (None, "other")])
def test_categories(spark, text, category):
    assert one(spark, M.category(F.lit(text).cast("string"))) == category


@pytest.mark.parametrize("name,text,kind", [("RLV_1.pdf", "", "bank_statement"), ("Releve.pdf", None, "bank_statement"), ("x.pdf", "a\nreleve de compte", "bank_statement"), ("x.pdf", "a" * 2000 + "RELEVE DE COMPTE", None), (None, None, None)])
def test_kinds(spark, name, text, kind):
    assert one(spark, S.kind(F.lit(name).cast("string"), F.lit(text).cast("string"))) == kind


def test_nodes_parse_each_statement_once(spark):
    parsed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    text = "RIB : 1 2\ndu 1 janvier 2024 au 31 janvier 2024\n| Date | Nature | Valeur | Débit | Crédit |\n| 02.01 | CARTE X | | 1,00 | |\n| 03.01 | VIR RECU | | | 2,50 |"
    docs = spark.createDataFrame([("a", text), ("b", text), ("c", None), ("", text), ("d", "no period")], "document_id string, content string")
    rows = S.transactions(docs.mapInArrow(counted, docs.schema))
    found = sorted((r.entity_type, r.source_id) for r in S.transaction_nodes(rows).collect())
    assert found == [("account", ""), ("document", "a"), ("document", "b"), ("transaction", "a"), ("transaction", "a"), *[("transaction_category", x) for x in "aabb"]]
    assert parsed.value == 5
