import datetime
import re
import random

import pytest

from factloom.operators import dates as D

from .helpers import one
from pyspark.sql import functions as F

DAY = datetime.date
CASES = [
    ("Facture émise le 12/03/2021 pour Nice", "x.pdf", DAY(2021, 3, 12)),
    ("Date : 2020-03-15\nautre 01/02/2022", "x.pdf", DAY(2020, 3, 15)),
    ("FAIT à CHATEAUNEUF Le 13 mai 2016", "scan.pdf", DAY(2016, 5, 13)),
    ("Né le 01/02/1980. Document", "releve_20210430.pdf", DAY(2021, 4, 30)),
    ("née le 22 avril 1980", "x.pdf", None),
    ("valid until 2030-01-01", "x.pdf", None),
    ("a 5 août 2008 b 22 avril 2016 c 2015/01/02", "x.pdf", DAY(2016, 4, 22)),
    ("date: 31/02/2021 et 2021-02-30", "x.pdf", None),
    ("date: rien. puis 2021-02-03", "2019-01-02 scan.pdf", DAY(2021, 2, 3)),
    ("rien", "99999999_2019-01-02.pdf", DAY(2019, 1, 2)),
    ("issued on 1/1/1850 then 1/1/2350", "x.pdf", None),
    ("x" * 2990 + " 2001-01-01 " + "y" * 4000 + " signé le 03.04.2005", "x.pdf", DAY(2005, 4, 3)),
    ("x" * 3200 + " 2001-01-01 " + "y" * 4000, "x.pdf", None),
    (None, None, None),
]


def test_cascade(spark):
    rows = D.with_document_date(spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(CASES)], "i int, content string, original_filename string"))
    assert [r.document_date for r in rows.orderBy("i").collect()] == [d for _, _, d in CASES]


def plain_candidates(text):
    """The dates of a text by Python's own search."""
    out = []
    for way, (pattern, (d, m, y)) in enumerate(D._WAYS):
        for found in re.finditer("(?i)" + pattern, text):
            month = D.MONTHS.get(found[m].lower(), found[m])
            if re.search(r"(?i)\b(?:" + "|".join(D.NOT_ISSUED) + r")\b", text[max(0, found.start() - 40) : found.start()]):
                continue
            try:
                day = DAY(int(found[y]), int(month), int(found[d]))
            except ValueError:
                continue
            if 1900 <= day.year <= 2100:
                out.append((found.start(), way, day))
    return out


def test_candidates_equal_a_plain_search(spark):
    rng = random.Random(5)
    parts = ["2020-03-15", "3/4/2021", "31.12.1999", "2021/2/3", "22 avril 2016", "5 Août 2008", " né le ", "depuis ", "expir ", " texte ", "x" * 30, "\n", "99", "-", "jusqu'au ", " 1 "]
    rows = [("".join(rng.choices(parts, k=rng.randint(0, 14))),) for _ in range(150)]
    got = one(spark, D.candidates(F.col("t")), rows, "t string")
    assert [sorted((c.at, c.way, c.day) for c in g) for g in got] == [sorted(plain_candidates(t)) for t, in rows]


def test_a_batch_is_searched_as_its_texts_are(spark):
    from factloom.functions.scan import matches

    rng = random.Random(2)
    texts = ["".join(rng.choices("ab \0", k=rng.randint(0, 6))) for _ in range(300)]
    for pattern in ("a+b", "b", "a ?a"):
        got = [(row, at, m[0]) for row, at, m in matches(texts, re.compile(pattern))]
        assert got == [(i, m.start(), m[0]) for i, t in enumerate(texts) for m in re.finditer(pattern, t)]
    assert not list(matches([], re.compile("a")))


@pytest.mark.parametrize("raw,good", [("1980-02-28", True), ("1980-02-31", False), ("1899-01-01", False), ("2999-01-01", False), ("1980-2-3", False), (None, False)])
def test_birthdates(spark, raw, good):
    assert one(spark, D.valid_birthdate(F.lit(raw).cast("string"))) is good
