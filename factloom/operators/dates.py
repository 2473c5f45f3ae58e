"""Dates of documents from their text, which is searched batch by batch, and from their file name."""

from __future__ import annotations

import datetime
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, IntegerType, StructField, StructType

from ..functions.scan import matches
from .documents import head_and_tail

#: French months, words that announce a date of issue, and words before dates that are none of issue.
MONTHS = {"janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8,
          "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12}
ISSUED = (r"émise?\s+le", r"emise?\s+le", r"date\s*[:\-]", "dated", r"signé\s+le", r"signe\s+le", r"rédigé\s+le", r"redige\s+le",
          r"issued(?:\s+on)?", r"generated\s+on", r"fait\s+(?:[aà]|le)")
NOT_ISSUED = (r"n[ée]e?", "naissance", "born", "depuis", r"jusqu[' ]?au?", "expir", r"valid\s+(?:from|until)", "birth", r"mari[ée]s?", "married")
SPAN, LOOK_BACK = 60, 40
#: Day, month and year of each way to write a date, by the numbers of their groups.
_WAYS = (
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", (3, 2, 1)), (r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})", (1, 2, 3)), (r"(\d{4})/(\d{1,2})/(\d{1,2})", (3, 2, 1)),
    (r"(\d{1,2})\s+(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\s+(\d{4})", (1, 2, 3)),
)
_FOUND = [(re.compile(pattern, re.IGNORECASE), groups) for pattern, groups in _WAYS]
_DISQUALIFIED = re.compile(r"\b(?:" + "|".join(NOT_ISSUED) + r")\b", re.IGNORECASE)
_MARK = re.compile("|".join(ISSUED), re.IGNORECASE)
#: What every date has; a text without it is searched no further.
_YEAR = re.compile(r"\d{4}")


def day_of(year: Column, month: Column, day: Column) -> Column:
    """A date of the years 1900 to 2100; null where there is none."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    found = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.year(found).between(1900, 2100), found)


def written_day(day: str, month: str, year: str) -> datetime.date | None:
    """A date of the years 1900 to 2100 from its numbers or the name of its month."""
    try:
        found = datetime.date(int(year), int(MONTHS.get(month.lower(), month)), int(day))
    except ValueError:
        return None
    return found if 1900 <= found.year <= 2100 else None


def _dates(texts: list[str]) -> list[list[tuple[int, int, datetime.date]]]:
    """(at, way, day) of the dates of each text; those with a word of NOT_ISSUED in the LOOK_BACK characters before are
    left out."""
    out: list[list] = [[] for _ in texts]
    for way, (pattern, (d, m, y)) in enumerate(_FOUND):
        for row, at, found in matches(texts, pattern):
            day = written_day(found[d], found[m], found[y])
            if day and not _DISQUALIFIED.search(texts[row][max(0, at - LOOK_BACK) : at]):
                out[row].append((at, way, day))
    return out


def _dated(texts: pd.Series) -> tuple[list[int], list[str]]:
    """The rows whose text has a year, and these texts."""
    rows = [i for i, t in enumerate(texts) if t is not None and _YEAR.search(t)]
    return rows, [texts.iloc[i] for i in rows]


@F.pandas_udf(ArrayType(StructType([StructField("at", IntegerType()), StructField("way", IntegerType()), StructField("day", DateType())])))
def _candidates(texts: pd.Series) -> pd.Series:
    rows, dated = _dated(texts)
    out: list[list] = [[] for _ in range(len(texts))]
    for i, found in zip(rows, _dates(dated)):
        out[i] = [{"at": at, "way": way, "day": day} for at, way, day in found]
    return pd.Series(out)


@F.pandas_udf(StructType([StructField("announced", DateType()), StructField("latest", DateType())]))
def _scanned(texts: pd.Series) -> pd.DataFrame:
    rows, dated = _dated(texts)
    after = [(row, text[at + len(m[0]) :][:SPAN]) for row, at, m in matches(dated, _MARK) for text in (dated[row],)]
    announced: list = [None] * len(texts)
    for (row, _), found in zip(after, _dates([t for _, t in after])):
        if found and announced[rows[row]] is None:
            announced[rows[row]] = min(found)[2]
    latest: list = [None] * len(texts)
    for i, found in zip(rows, _dates(dated)):
        latest[i] = max((day for _, _, day in found), default=None)
    return pd.DataFrame({"announced": announced, "latest": latest}, dtype=object)


def candidates(text: Column) -> Column:
    """The dates in ``text`` as {at, way, day}; those with a word of NOT_ISSUED in the characters before are left out."""
    return _candidates(text)


def scanned(text: Column) -> Column:
    """{announced, latest}: the first date within SPAN characters after a word of ISSUED, of the first such word that
    has one, and the latest date."""
    return _scanned(text)


def filename_date(name: Column) -> Column:
    """The first YYYYMMDD of a file name if it is a date, else its first YYYY-MM-DD if that is one."""
    first = lambda p: day_of(*(F.regexp_extract(name, p, k) for k in (1, 2, 3)))
    return F.coalesce(first(r"(\d{4})(\d{2})(\d{2})"), first(r"(\d{4})-(\d{2})-(\d{2})"))


def with_document_date(docs: DataFrame, text_col: str = "content", name_col: str = "original_filename") -> DataFrame:
    """``docs`` with document_date: the announced date in the head and tail of the text, else that of the file name,
    else the latest in them."""
    rows = docs.withColumn("__window", head_and_tail(F.coalesce(text_col, F.lit(""))))
    rows = rows.withColumn("__found", scanned(F.col("__window")))
    named = filename_date(F.coalesce(name_col, F.lit("")))
    return rows.withColumn("document_date", F.coalesce("__found.announced", named, "__found.latest")).drop("__window", "__found")


def iso_date(raw: Column) -> Column:
    """A date written YYYY-MM-DD and nothing else."""
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))


def valid_birthdate(raw: Column) -> Column:
    """Whether it is an ISO date from 1900 to this year."""
    return F.coalesce(F.year(iso_date(raw)).between(F.lit(1900), F.year(F.current_date())), F.lit(False))
