"""Row generators of extraction packs: functions that make typed rows of a document, joined laterally."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_structured(docs: DataFrame, generator: Callable[..., DataFrame], *columns: str) -> DataFrame:
    """The rows that ``generator``, a Python table function, makes of ``columns`` of each document, with the other columns
    of ``docs``; a document for which it makes none has none. The rows have the generator's own schema."""
    return docs.lateralJoin(generator(*(F.col(c).outer() for c in columns))).drop(*columns)
