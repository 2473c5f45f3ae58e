import random
import re

from pyspark.sql import functions as F

from factloom.operators import dates, money, statements

from .helpers import one


def test_cells_equal_a_plain_split():
    rng = random.Random(4)
    rows = ["", "|", "||", " | ", "|a", "a|", " a ", *("".join(rng.choices(["|", " ", "\t", "a", "é b"], k=rng.randint(0, 9))) for _ in range(200))]
    want = [re.split(r"\s*\|\s*", re.sub(r"\s*\|?\s*$", "", re.sub(r"^\s*\|?\s*", "", r), count=1)) for r in rows]
    assert [statements.cells(r) for r in rows] == want


def test_categories_go_by_the_first_rule_that_fits(spark):
    rules = (("A.B", "dot"), ("VIR", "first"), ("VIR X", "never"), ("a", "lower"))
    texts = ["a.b", "axb", " ** vir x", "* * vir", "", None, "z"]
    assert one(spark, money.category(F.col("t"), rules), [(t,) for t in texts], "t string") == ["dot", "lower", "first", "other", "other", "other", "other"]


def test_texts_without_a_year_have_no_dates(spark):
    texts = ["date : 12/03/21", "", None]
    assert [c or [] for c in one(spark, dates.candidates(F.col("t")), [(t,) for t in texts], "t string")] == [[], [], []]
    assert one(spark, dates.scanned(F.col("t"))["latest"], [(t,) for t in texts], "t string") == [None] * 3
