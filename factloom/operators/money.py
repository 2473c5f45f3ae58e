"""Transactions: amounts, categories, validation and spend buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What descriptions begin with, the first that fits, and the category it stands for.
CATEGORIES = (
    ("SOLDE", "balance"), ("VIR SEPA RECU", "transfer_in"), ("VIR CPTE A CPTE RECU", "transfer_in"), ("VIR RECU", "transfer_in"),
    ("VIR SCT INST RECU", "transfer_in"), ("VIR CPTE A CPTE EMIS", "transfer_out"), ("VIR SCT INST EMIS", "transfer_out"),
    ("VIR SEPA EMIS", "transfer_out"), ("VIR EMIS", "transfer_out"), ("VIR", "transfer_out"), ("CARTE", "card_payment"),
    ("PRLV", "direct_debit"), ("CHEQUE", "cheque"), ("COMMISSION", "fee"), ("FRAIS", "fee"), ("AGIOS", "fee"),
    ("INTERETS", "interest"), ("DEPOT", "deposit"), ("RETRAIT", "withdrawal"),
)


def french_number(raw: Column) -> Column:
    """'1 209,10' as a decimal; null where it is none."""
    bare = F.replace(F.regexp_replace(raw, r"^\s+|\s+$|[ \x{A0}]", ""), F.lit(","), F.lit("."))
    return F.when(bare.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), bare.try_cast("decimal(18,2)"))


def category(description: Column, rules: tuple[tuple[str, str], ...] = CATEGORIES, default: str = "other") -> Column:
    """The category of the first prefix in ``rules`` that the description, without blanks and asterisks before it,
    begins with."""
    begins = "|".join(re.escape(prefix.upper()) for prefix, _ in rules)
    found = F.regexp_extract(F.upper(F.coalesce(description, F.lit(""))), rf"^\s*+\**+\s*+({begins})", 1)
    names = {prefix.upper(): name for prefix, name in reversed(rules)}
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[found], F.lit(default))


def valid(debit: Column, credit: Column, description: Column) -> Column:
    """Exactly one of debit and credit, not negative, and a description."""
    return (debit.isNull() != credit.isNull()) & (F.coalesce(debit, credit) >= 0) & (F.length(description) > 0)


def direction(debit: Column) -> Column:
    return F.when(debit.isNotNull(), "debit").otherwise("credit")


def amount(debit: Column, credit: Column) -> Column:
    """The amount without its sign."""
    return F.coalesce(debit, credit)


def spend(transactions: DataFrame, *keys: str) -> DataFrame:
    """Sum and number of amounts by the keys, in decimals."""
    return transactions.groupBy(*keys).agg(F.sum("amount").cast("decimal(38,2)").alias("total"), F.count(F.lit(1)).alias("n"))
