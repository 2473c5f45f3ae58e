"""Small helpers of the tests."""

from pyspark.sql import functions as F


def one(spark, column, rows=None, schema="x int"):
    """The value of an expression, of one row unless ``rows`` are given."""
    got = [r[0] for r in spark.createDataFrame(rows or [(1,)], schema).select(column).collect()]
    return got if rows else got[0]


def texts(*values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
