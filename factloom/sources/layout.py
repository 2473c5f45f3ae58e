"""A store of facts laid out for lookups: every table by buckets of its key, sorted in them, with bloom filters.

A lookup reads one bucket's folder, and of its files only row groups whose statistics and bloom filter allow the key.
``members`` is the inverted index from facts to the conflicts that hold them. Buckets are the first hexadecimal digits
of SHA-256 keys, so they are even, and reading them in order is reading by id.
"""

from __future__ import annotations

import hashlib
import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.facts import as_of

#: Rows that a bucket should have at most, buckets' digits at most, partitions they are dealt to, and keys that are looked up one by one.
ROWS, DIGITS, PARTS, SOME = 1 << 20, 4, 4096, 256
_HEX = "0123456789abcdef"


def is_id(key: str) -> bool:
    """Whether it is a SHA-256 in lower case; nothing else is an id."""
    return len(key) == 64 and set(key) <= set(_HEX)


#: The key of each table.
KEYS = {"facts": "id", "subjects": "subject_id", "claims": "fact_id", "conflicts": "id", "members": "fact_id"}


def digits_for(n: int) -> int:
    """How many digits of its key name the bucket of a row, if there are ``n`` facts."""
    return next(k for k in range(1, DIGITS + 1) if n <= ROWS * 16**k or k == DIGITS)


def dealt(rows: DataFrame, name: str, digits: int) -> DataFrame:
    """``rows`` of a table dealt by their bucket; what is computed of them by bucket needs no further shuffle."""
    key = F.sha2("subject_id", 256) if name == "subjects" else F.col(KEYS[name])
    return rows.withColumn("bucket", F.substring(key, 1, digits)).repartition(min(16**digits, PARTS), "bucket")


def write_dealt(path: str, name: str, rows: DataFrame) -> None:
    """Write the table ``name`` from ``rows`` that are ``dealt``."""
    key = KEYS[name]
    out = rows.sortWithinPartitions("bucket", key).write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("compression", "zstd")
    out.option(f"parquet.bloom.filter.expected.ndv#{key}", ROWS).option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy("bucket").parquet(f"{path}/{name}")
    spark = rows.sparkSession
    if name == "conflicts":
        counts = spark.read.schema(rows.schema).parquet(f"{path}/{name}").groupBy("status", "bucket").agg(F.count(F.lit(1)).alias("n"))
        counts.coalesce(1).write.parquet(f"{path}/conflict_counts")  # a row a bucket and status
    spark.createDataFrame([(name, rows.schema.json())], "name string, kind string").coalesce(1).write.mode("append").parquet(f"{path}/kinds")


def members(conflicts: DataFrame) -> DataFrame:
    """(fact_id, conflict_id): the table of members."""
    return conflicts.select(F.explode(F.array_distinct("competing_fact_ids")).alias("fact_id"), F.col("id").alias("conflict_id"))


def write_store(path: str, facts: DataFrame, claims: DataFrame, conflicts: DataFrame) -> None:
    """Write facts (id, subject_id, predicate, ...) by id and by subject, claims (id, fact_id, ...), conflicts (id,
    status, competing_fact_ids, ...) and their members."""
    digits = digits_for(facts.count())
    for name, rows in {"facts": facts, "subjects": facts, "claims": claims, "conflicts": conflicts}.items():
        write_dealt(path, name, dealt(rows, name, digits))
    write_dealt(path, "members", dealt(members(Store(facts.sparkSession, path).conflict), "members", digits))


class Store:
    """The tables of ``write_store``, or those of them that were written; their files are listed once."""

    def __init__(self, spark: SparkSession, path: str):
        kinds = {r.name: StructType.fromJson(json.loads(r.kind)) for r in spark.read.parquet(f"{path}/kinds").collect()}
        self.by_id, self.by_subject, self.claim, self.conflict, self.member = (spark.read.schema(kinds[x]).parquet(f"{path}/{x}") if x in kinds else None for x in ("facts", "subjects", "claims", "conflicts", "members"))
        self.counts = sorted((r.bucket, r.status, r.n) for r in spark.read.parquet(f"{path}/conflict_counts").collect()) if "conflicts" in kinds else []
        self.tables = frozenset(kinds)

    def has(self, table: str) -> bool:
        return table in self.tables

    def _at(self, table: DataFrame, key: str, *values: str) -> DataFrame:
        good = [v for v in values if is_id(v)]
        if not good:
            return table.drop("bucket").where(F.lit(False))
        near = F.col("bucket").isin([v[:d] for v in good for d in range(1, DIGITS + 1)])
        return table.where(near & F.col(key).isin(good)).drop("bucket")

    def fact(self, fact_id: str) -> DataFrame:
        return self._at(self.by_id, "id", fact_id)

    def claims_of(self, fact_id: str) -> DataFrame:
        return self._at(self.claim, "fact_id", fact_id)

    def conflicts_with(self, fact_id: str) -> DataFrame:
        """The conflicts that hold a fact; it has one subject and predicate, so they are few."""
        return self._at(self.conflict, "id", *[r.conflict_id for r in self._at(self.member, "fact_id", fact_id).collect()])

    def of_subject(self, subject: str, predicate: str | None = None, day: date | None = None) -> DataFrame:
        """Facts of a subject, of one predicate or valid on a day if these are given."""
        digest = hashlib.sha256(subject.encode()).hexdigest()
        rows = self.by_subject.where(F.col("bucket").isin([digest[:d] for d in range(1, DIGITS + 1)]) & (F.col("subject_id") == subject)).drop("bucket")
        rows = rows if predicate is None else rows.where(F.col("predicate") == predicate)
        return rows if day is None else as_of(rows, F.lit(day))

    def detail(self, fact_id: str) -> DataFrame:
        """A fact with the records of its claims and conflicts, by id; no row if it isn't there."""
        tables = {"fact": self.fact(fact_id), "claims": self.claims_of(fact_id), "conflicts": self.conflicts_with(fact_id)}
        rows = None  # one pass over the three, each row in a column of its own
        for name, df in tables.items():
            part = df.select(F.struct("id", *(c for c in df.columns if c != "id")).alias(name))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        listed = (F.array_sort(F.collect_list(c)).alias(c) for c in ("claims", "conflicts"))
        return rows.agg(F.first("fact", ignorenulls=True).alias("fact"), *listed).where("fact is not null").select("fact.*", "claims", "conflicts")

    def conflict_detail(self, conflict_id: str) -> DataFrame:
        """(conflict_id, fact_id, canonical_value, claims) of each member with the records of its claims; a member that
        isn't there has no value."""
        members = self._at(self.conflict, "id", conflict_id).select(F.col("id").alias("conflict_id"), F.explode("competing_fact_ids").alias("fact_id"))
        some = [r.fact_id for r in members.select("fact_id").take(SOME + 1)]
        few = len(some) <= SOME  # then their buckets alone are read, else all are joined
        claims = self._at(self.claim, "fact_id", *some) if few else self.claim.drop("bucket").join(members.select("fact_id"), "fact_id", "left_semi")
        facts = self._at(self.by_id, "id", *some) if few else self.by_id
        columns = [c for c in claims.columns if c not in ("id", "fact_id")]
        own = claims.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("id", *columns))).alias("claims"))
        rows = members.join(facts.select(F.col("id").alias("fact_id"), "canonical_value"), "fact_id", "left").join(own, "fact_id", "left")
        return rows.select("conflict_id", "fact_id", "canonical_value", F.coalesce("claims", F.array().cast(own.schema["claims"].dataType)).alias("claims"))

    def conflicts(self, status: str | None = None, limit: int = 100) -> DataFrame:
        """The first ``limit`` conflicts by id, of one status or all, with their total; only as many buckets are read as
        hold them (a page is the feature)."""
        mine = [(b, n) for b, s, n in self.counts if status is None or s == status]
        wanted, held = [], 0
        for bucket, n in mine:
            if held >= limit and bucket not in wanted:
                break
            wanted, held = [*wanted, bucket], held + n
        rows = self.conflict.where(F.col("bucket").isin(wanted)) if wanted else self.conflict.where(F.lit(False))
        rows = rows if status is None else rows.where(F.col("status") == status)
        return rows.orderBy("id").limit(limit).withColumn("total", F.lit(sum(n for _, n in mine)).cast("long")).drop("bucket")
