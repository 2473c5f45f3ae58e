"""Text functions that Spark has no built-in for, and composites of those it has."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else _bare(s).strip().lower())


@F.pandas_udf(StringType())
def _normal(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else " ".join(_bare(s).casefold().split()))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(StringType())
def _slug(names: pd.Series) -> pd.Series:
    return names.map(lambda s: re.sub(r"[^a-z0-9]+", "_", _bare(s or "").casefold()).strip("_") or "unnamed")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain(text: Column | str) -> Column:
    """Whether a text has ASCII characters only, which need no decomposing."""
    return _col(text).rlike(r"^\p{ASCII}*$")


def _rest(text: Column | str, python) -> Column:
    """``python`` of the texts that aren't plain; the others reach Python as nulls."""
    return python(F.when(~plain(text), _col(text)))


def slug(names: Column | str) -> Column:
    """Folded, other runs than letters and digits as one '_', 'unnamed' if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(_col(names)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    known = F.coalesce(F.nullif(bare, F.lit("")), F.lit("unnamed"))
    return F.when(_col(names).isNull() | plain(names), known).otherwise(_rest(names, _slug))


BLANKS = r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def fold(text: Column | str) -> Column:
    """Without accents, trimmed, lower-cased."""
    return F.when(plain(text), F.lower(F.regexp_replace(_col(text), BLANKS, ""))).otherwise(_rest(text, _folded))


def normal_name(name: Column | str) -> Column:
    """Without accents, case-folded, white space collapsed."""
    collapsed = F.regexp_replace(F.regexp_replace(_col(name), BLANKS, ""), r"[\s\x1C-\x1F]+", " ")
    return F.when(plain(name), F.lower(collapsed)).otherwise(_rest(name, _normal))


def composed(text: Column | str) -> Column:
    """In normal form C."""
    return F.when(plain(text), _col(text)).otherwise(_rest(text, _composed))


def subject_id(name: Column | str) -> Column:
    """'entity:' and the slug of a name with '-' between; 'entity:unknown' without one."""
    s = F.replace(slug(_col(name)), F.lit("_"), F.lit("-"))
    return F.concat(F.lit("entity:"), F.when(fold(F.coalesce(_col(name), F.lit(""))).rlike("[a-z0-9]"), s).otherwise("unknown"))


def words_in_order(short: Column, long: Column) -> Column:
    """Whether the words of ``short`` occur in ``long`` in this order, with others between; false if empty."""
    a, b = F.split(F.trim(short), r"\s+"), F.split(F.trim(long), r"\s+")
    # what a lambda needs is handed to it, as it can't refer to a Python function's result
    step = lambda s, w: F.struct((s["k"] + F.when(F.get(s["a"], s["k"]) == w, 1).otherwise(0)).alias("k"), s["a"].alias("a"))
    matched = F.aggregate(b, F.struct(F.lit(0).alias("k"), a.alias("a")), step)["k"]
    return (F.trim(short) != "") & (F.trim(long) != "") & (matched == F.size(a))


def equal_normal_names(a: Column, b: Column) -> Column:
    """``lexically_equal`` of names that are normal already."""
    fewer = F.size(F.split(a, " ")) <= F.size(F.split(b, " "))
    return F.coalesce((a != "") & (b != "") & ((a == b) | F.when(fewer, words_in_order(a, b)).otherwise(words_in_order(b, a))), F.lit(False))


def lexically_equal(a: Column, b: Column) -> Column:
    """Equal normal names, or the words of the one with fewer in order within the other."""
    return equal_normal_names(normal_name(a), normal_name(b))


def ids_of(field: Column) -> Column:
    """A '<SEP>'-joined field as an array, without empty parts; a null has none."""
    return F.filter(F.split(F.coalesce(field, F.lit("")), "<SEP>"), lambda x: x != "")


def joined_ids(ids: Column) -> Column:
    return F.array_join(ids, "<SEP>")


def without_fences(raw: Column) -> Column:
    return F.regexp_replace(F.trim(raw), r"^\s*```[a-z]*\s*|\s*```\s*$", "")


def json_objects(raw: Column) -> Column:
    """The objects of a JSON array, as strings, code fences taken off; empty where it is no array."""
    items = F.try_variant_get(F.try_parse_json(without_fences(raw)), "$", "array<variant>")
    texts = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda v: F.to_json(v))
    return F.filter(texts, lambda t: t.startswith("{"))
