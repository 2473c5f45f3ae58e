"""Bank statements: transactions from Markdown tables, their facts, claims, nodes and edges."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import money
from .dates import MONTHS
from .facts import GROUP, content_id

#: What rows that are no transactions begin with, and how kinds of documents are told.
SKIPPED = ("SOLDE ", "TOTAL DES OPERATIONS")
STATEMENT_NAME, STATEMENT_TEXT = r"(?i)^(?:RLV|releve)", "RELEVE DE COMPTE"
EXTRACTOR = "pack:bank_statement@0.3.0"
LOW_SIGNAL = ("transaction", "transaction_category", "account")
_DAY = r"(\d{1,2})\s+([A-Za-zéû]+)\s+(\d{4})"
_PERIOD = re.compile(rf"du\s+{_DAY}\s+au\s+{_DAY}", re.IGNORECASE)
_RIB = re.compile(r"RIB\s*:\s*([0-9 ]+?)(?=\s*$|\s+IBAN|\n)", re.MULTILINE)
_SEPARATOR, _DAY_MONTH = re.compile(":?-+:?"), re.compile(r"(\d{1,2})\.(\d{1,2})")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_CENT, _LARGEST = Decimal("0.01"), Decimal(10) ** 16
RECORD = "row int, date date, value_date date, description string, debit decimal(18,2), credit decimal(18,2), account_rib string"


def kind(filename: Column, content: Column) -> Column:
    """'bank_statement' by the file name or the first 2000 characters, else null."""
    return F.when(F.coalesce(filename, F.lit("")).rlike(STATEMENT_NAME) | F.contains(F.upper(F.substring(F.coalesce(content, F.lit("")), 1, 2000)), F.lit(STATEMENT_TEXT)), "bank_statement")


def _day(day: str, month: str, year: str) -> datetime.date | None:
    try:
        return datetime.date(int(year), MONTHS[month.lower()], int(day))
    except (KeyError, ValueError):
        return None


def period(text: str) -> tuple[datetime.date, datetime.date] | None:
    """The two days of 'du 1 janvier 2024 au 31 janvier 2024'; None where one of them is none."""
    found = _PERIOD.search(text)
    days = found and (_day(*found.groups()[:3]), _day(*found.groups()[3:]))
    return days if days and all(days) else None


def rib(text: str) -> str | None:
    """The account number with single blanks."""
    found = _RIB.search(text)
    return found and " ".join(found[1].split()) or None


def day_in(raw: str, during: tuple[datetime.date, datetime.date]) -> datetime.date | None:
    """'DD.MM' as a date of the period: in a period over the turn of the year, months from its first on are of the
    first year."""
    found = _DAY_MONTH.fullmatch(raw)
    if not found:
        return None
    d, m = map(int, found.groups())
    start, end = during
    try:
        return datetime.date(start.year if start.year == end.year or m >= start.month else end.year, m, d)
    except ValueError:
        return None


def amount(raw: str) -> Decimal | None:
    """'1 209,10' as a decimal of two places; None where it is none or too large."""
    bare = raw.strip().replace(" ", "").replace("\xa0", "").replace(",", ".")
    number = Decimal(bare) if _NUMBER.fullmatch(bare) and bare.isascii() else None
    return None if number is None or abs(number) >= _LARGEST else number.quantize(_CENT, ROUND_HALF_UP)


def cells(row: str) -> list[str]:
    """The trimmed cells of a table row, without its outer bars."""
    row = row.strip()
    row = row[1:].lstrip() if row.startswith("|") else row
    row = row[:-1] if row.endswith("|") else row
    return [c.strip() for c in row.split("|")]


def _body(table: list[list[str]]) -> list[list[str]]:
    """The rows of a table that follow its header, which has date and debit."""
    heads = (i for i, row in enumerate(table) if "ate" in (line := " ".join(row).lower()) and "ébit" in line)
    return table[next(heads, len(table)) + 1 :]


def statement_rows(content: str | None) -> Iterator[tuple]:
    """The transactions of a statement, as the fields of RECORD, numbered from 0: rows below the header of a table, as
    long as lines are rows, that have a date of the period, a description and a debit or a credit. A text without a
    period has none, and rows that don't parse are left out."""
    during = period(content) if content else None
    if during is None:
        return
    account, n = rib(content), 0
    for is_table, lines in groupby(content.splitlines(), lambda line: line.lstrip().startswith("|")):
        rows = [c for c in map(cells, lines) if any(x and not _SEPARATOR.fullmatch(x) for x in c)] if is_table else []
        for day, text, value_day, debit, credit in (r[:5] for r in _body(rows) if len(r) >= 5):
            when, debit, credit = day_in(day, during), amount(debit), amount(credit)
            one = (debit is None) != (credit is None)
            if when and text and not text.upper().startswith(SKIPPED) and one and (debit if credit is None else credit) >= 0:
                yield n, when, day_in(value_day, during) or when, text, debit, credit, account
                n += 1


@F.udtf(returnType=RECORD, useArrow=False)
class StatementRows:
    """``statement_rows`` as a row generator."""

    def eval(self, content: str):
        yield from statement_rows(content)


_ARROW = (pa.int32(), pa.date32(), pa.date32(), pa.string(), pa.decimal128(18, 2), pa.decimal128(18, 2), pa.string())


def _batches_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of transactions for each of (document_id, content)."""
    for batch in batches:
        found = [[*statement_rows(text)] for text in batch.column(1).to_pylist()]
        ids = batch.column(0).take(pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64()))
        columns = [*zip(*chain.from_iterable(found))] or [()] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns, _ARROW)], ["document_id", *(f.split()[0] for f in RECORD.split(", "))])


def transactions(docs: DataFrame) -> DataFrame:
    """(source_doc_id, row, date, value_date, description, debit, credit, amount, direction, category, account_rib) of
    the statements ``docs`` (document_id, content), as ``statement_rows`` finds them, a batch of documents at once."""
    docs = docs.where(F.coalesce("document_id", F.lit("")) != "").select(F.col("document_id").cast("string"), F.col("content").cast("string"))
    rows = docs.mapInArrow(_batches_of_rows, "document_id string, " + RECORD)
    return rows.select(
        F.col("document_id").alias("source_doc_id"), "row", "date", "value_date", "description", "debit", "credit",
        F.coalesce("debit", "credit").alias("amount"), money.direction(F.col("debit")).alias("direction"), money.category(F.col("description")).alias("category"), "account_rib")


def account_name(number: Column) -> Column:
    return F.concat(F.lit("account:"), F.coalesce(F.when(number != "", number), F.lit("unknown")))


def transaction_name() -> Column:
    """Direction, amount, day and the first 60 characters, with a short hash of the whole description."""
    short = F.substring(F.replace(F.trim("description"), F.lit("\n"), F.lit(" ")), 1, 60)
    return F.concat(F.lit("Transaction "), "direction", F.lit(" "), F.col("amount").cast("string"), F.lit(" EUR "), F.col("date").cast("string"), F.lit(" "), short, F.lit(" ["), F.substring(F.md5("description"), 1, 4), F.lit("]"))


def document_name(document_id: Column) -> Column:
    return F.concat(F.lit("Document /store/"), document_id, F.lit("/ (bank statement)"))


def summary_name(document_id: Column, direction: Column, category: Column) -> Column:
    return F.concat(F.lit("Expense summary "), category, F.lit(" ("), direction, F.lit(") from bank statement "), document_id)


def transaction_facts(rows: DataFrame) -> DataFrame:
    """The fact of each transaction, with the id of its claim."""
    facts = rows.select(account_name(F.col("account_rib")).alias("subject_id"), F.lit("transaction").alias("predicate"), transaction_name().alias("canonical_value"), "source_doc_id", F.col("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
                        F.lit("deterministic").alias("confidence"), F.concat(F.lit("row:"), F.col("row").cast("string")).alias("source_location"))
    facts = facts.withColumn("id", content_id(*GROUP, "canonical_value", "source_doc_id"))
    return facts.withColumn("claim_id", F.sha2(F.concat_ws("|", "id", "source_doc_id", "source_location", F.lit(EXTRACTOR)), 256))


def transaction_nodes(rows: DataFrame) -> DataFrame:
    """(name, entity_type, description, source_id) of the summaries, transactions, accounts and documents, each once.
    The rows are written once, as each of the four reads them."""
    rows = written(rows.select("source_doc_id", "row", "date", "description", "amount", "direction", "category", "account_rib"), "transactions")
    total = rows.groupBy("source_doc_id", "direction", "category").agg(F.sum("amount").cast("decimal(38,2)").alias("total"), F.count(F.lit(1)).alias("n"))
    said = F.concat(F.lit("Bank statement aggregate: category "), "category", F.lit(" ("), "direction", F.lit("/"), F.when(F.col("direction") == "debit", "expense").otherwise("income"), F.lit(") totalling "), F.col("total").cast("string"),
                    F.lit(" EUR across "), F.col("n").cast("string"), F.lit(" transaction(s). Source document: "), "source_doc_id", F.lit("."))
    nodes = total.select(summary_name(F.col("source_doc_id"), F.col("direction"), F.col("category")).alias("name"), F.lit("transaction_category").alias("entity_type"), said.alias("description"), F.col("source_doc_id").alias("source_id"))
    told = F.concat(F.lit("Bank transaction on "), F.col("date").cast("string"), F.lit(" ("), "direction", F.lit(") of "), F.col("amount").cast("string"), F.lit(" EUR, category "), "category", F.lit(". Description: "), "description", F.lit("."))
    first = rows.select(transaction_name().alias("name"), told.alias("description"), "source_doc_id", "row").groupBy("name").agg(F.min_by(F.struct("description", "source_doc_id"), F.struct("source_doc_id", "row")).alias("f"))
    nodes = nodes.union(first.select("name", F.lit("transaction"), "f.description", "f.source_doc_id"))
    accounts = rows.select(account_name(F.col("account_rib")).alias("name")).distinct()
    nodes = nodes.union(accounts.select("name", F.lit("account"), F.concat(F.lit("account "), "name"), F.lit("")))
    papers = rows.select("source_doc_id").distinct().select(document_name(F.col("source_doc_id")).alias("name"), "source_doc_id")
    return nodes.union(papers.select("name", F.lit("document"), F.concat(F.lit("document "), "name"), "source_doc_id"))


def transaction_edges(rows: DataFrame) -> DataFrame:
    """(src, tgt, relation), each once: a transaction's account, document and summary, and a summary's document."""
    name, paper = transaction_name(), document_name(F.col("source_doc_id"))
    summary = summary_name(F.col("source_doc_id"), F.col("direction"), F.col("category"))
    links = ((name, account_name(F.col("account_rib")), "on_account"), (name, paper, "from_document"), (name, summary, "in_category"), (summary, paper, "summary_of_document"))
    return rows.select(F.explode(F.array(*(F.struct(a.alias("src"), b.alias("tgt"), F.lit(r).alias("relation")) for a, b, r in links))).alias("e")).select("e.*").distinct()


def new_edges(edges: DataFrame, nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` and no edge between the two stored yet, one a pair of ends."""
    names = nodes.select("name").distinct()
    rows = edges.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "tgt"), "tgt", "left_semi")
    ends = (F.least("src", "tgt").alias("u"), F.greatest("src", "tgt").alias("v"))
    rows = rows.select("*", *ends).join(stored.select(*ends).distinct(), ["u", "v"], "left_anti")
    return rows.groupBy("u", "v").agg(F.min(F.struct("relation", "src", "tgt")).alias("e")).select("e.src", "e.tgt", "e.relation")


def summary_lines(rows: DataFrame) -> DataFrame:
    """(document_id, at, line) of each document's totals by direction and category, the largest first; what is no
    number counts 0."""
    total = rows.groupBy("source_doc_id", "direction", "category").agg(F.sum("amount").cast("decimal(38,2)").alias("total"), F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("Category "), "category", F.lit(" ("), "direction", F.lit("): "), F.col("total").cast("string"), F.lit(" EUR across "), F.col("n").cast("string"), F.lit(" transactions"))
    order = Window.partitionBy("source_doc_id").orderBy(F.desc(F.coalesce(F.col("total").try_cast("double"), F.lit(0.0))), "direction", "category")
    return total.select(F.col("source_doc_id").alias("document_id"), F.row_number().over(order).alias("at"), line.alias("line"))
