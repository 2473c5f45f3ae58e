"""Facts, claims and conflicts: identities, detection, supersession, points in time, replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["subject_id", "predicate"]


def content_id(*columns: str) -> Column:
    """SHA-256 of the columns joined by '|'."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def with_fact_id(facts: DataFrame) -> DataFrame:
    return facts.withColumn("id", content_id("subject_id", "predicate", "canonical_value", "source_doc_id"))


def keep_first(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def keep_last(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def with_contract(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """time_varying and allow_multi of each fact's predicate, both false where it isn't registered. The registry is a
    small dimension; whether to broadcast it is left to its measured size."""
    known = predicates.select("predicate", "time_varying", "allow_multi")
    return facts.join(known, "predicate", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("time_varying", "allow_multi")})


def claims(facts: DataFrame, location: Column, extractor: str) -> DataFrame:
    rows = facts.select(F.col("id").alias("fact_id"), "source_doc_id", location.alias("source_location"), F.lit(extractor).alias("extractor"))
    return rows.withColumn("id", content_id("fact_id", "source_doc_id", "source_location", "extractor"))


def detect_conflicts(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """One open conflict for each (subject, predicate) that doesn't allow several values and has them, with all its
    facts' ids, sorted."""
    groups = with_contract(facts, predicates).where("not allow_multi").groupBy(*GROUP).agg(
        (F.min("canonical_value") < F.max("canonical_value")).alias("differ"), F.array_sort(F.collect_set("id")).alias("competing_fact_ids"))
    return groups.where("differ").select(content_id(*GROUP).alias("id"), *GROUP, "competing_fact_ids", F.lit("open").alias("status"))


def detect_for_new(new: DataFrame, facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """Conflicts of newly arrived facts: each with the peers of its group that hold another value."""
    peers = facts.select(*GROUP, F.col("id").alias("peer"), F.col("canonical_value").alias("other"))
    met = with_contract(new, predicates).where("not allow_multi").join(peers, GROUP).where("peer <> id and other <> canonical_value")
    found = met.groupBy("id", *GROUP).agg(F.collect_set("peer").alias("peers"))
    return found.select(content_id(*GROUP).alias("conflict_id"), *GROUP, F.col("id").alias("fact_id"), F.array_sort(F.array_union("peers", F.array("id"))).alias("competing_fact_ids"))


def rerun_conflicts(detected: DataFrame, stored: DataFrame) -> DataFrame:
    """Detected conflicts with the status, members and, where ``stored`` has them, resolutions already stored; stored
    ones no longer detected are forgotten."""
    kept = ["resolution"] if "resolution" in stored.columns else []
    old = stored.select("id", F.col("competing_fact_ids").alias("__old"), F.col("status").alias("__status"), *kept)
    rows = detected.join(old, "id", "left")
    members = F.array_sort(F.array_union("competing_fact_ids", F.coalesce("__old", F.array().cast("array<string>"))))
    return rows.select("id", *GROUP, members.alias("competing_fact_ids"), F.coalesce("__status", "status").alias("status"), *kept)


def with_new_conflicts(stored: DataFrame, found: DataFrame) -> DataFrame:
    """``stored`` conflicts and those of ``detect_for_new``: members are united, a stored status stays, others open."""
    new = found.groupBy(F.col("conflict_id").alias("id")).agg(*(F.first(c).alias(c) for c in GROUP), F.array_sort(F.array_distinct(F.flatten(F.collect_list("competing_fact_ids")))).alias("new"))
    rows = stored.select("id", *(F.col(c).alias(f"__{c}") for c in GROUP), F.col("competing_fact_ids").alias("old"), "status").join(new, "id", "full")
    none = F.array().cast("array<string>")
    members = F.array_sort(F.array_union(F.coalesce("old", none), F.coalesce("new", none)))
    return rows.select("id", *(F.coalesce(f"__{c}", c).alias(c) for c in GROUP), members.alias("competing_fact_ids"), F.coalesce("status", F.lit("open")).alias("status"))


def supersede(facts: DataFrame, predicates: DataFrame, dealt_by: tuple[str, ...] = ()) -> DataFrame:
    """Close each dated fact of a varying, single-valued predicate the day before the next one begins. A given end
    stays, and so do facts that begin on the same day as the next. Facts that are dealt by columns which their subject
    sets stay where they are."""
    rows = with_contract(facts, predicates)
    applies = F.col("time_varying") & ~F.col("allow_multi") & F.col("valid_from").isNotNull()
    order = Window.partitionBy(*dealt_by, *GROUP, applies).orderBy("valid_from", "seq")
    follows = F.when(applies, F.lead("valid_from").over(order))
    end = F.when(F.col("valid_to").isNull() & (follows != F.col("valid_from")), F.date_sub(follows, 1)).otherwise(F.col("valid_to"))
    return rows.withColumn("valid_to", end).drop("time_varying", "allow_multi")


def as_of(facts: DataFrame, day: Column) -> DataFrame:
    """Facts valid on ``day``, both ends included and null ends open."""
    return facts.where((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))


def replacement_chains(corrections: DataFrame) -> DataFrame:
    """(place, old_doc, new_doc) of the source corrections (document_id, replaced_by) that name a successor, in order
    of their ids."""
    rows = corrections.where(F.coalesce("replaced_by", F.lit("")) != "")
    return rows.select(F.col("document_id").alias("place"), F.col("document_id").alias("old_doc"), F.col("replaced_by").alias("new_doc"))


def replacements(facts: DataFrame, chains: DataFrame, dates: DataFrame, predicates: DataFrame) -> DataFrame:
    """(place, seq, old_id, new_id, old_doc, new_doc, valid_to): each fact of a replaced document with the last fact of
    the new document for the same subject and predicate. valid_to is what the old fact is to end with, the day before
    the new one begins or before its document's date, and null where its predicate doesn't vary or it has an end."""
    new = keep_last(facts, ["source_doc_id", *GROUP]).select(F.col("source_doc_id").alias("new_doc"), *GROUP, F.col("id").alias("new_id"), F.col("valid_from").alias("new_from"))
    old = with_contract(facts, predicates).select("seq", F.col("source_doc_id").alias("old_doc"), *GROUP, F.col("id").alias("old_id"), "valid_to", "time_varying")
    pairs = old.join(chains, "old_doc").join(new, ["new_doc", *GROUP]).join(dates, F.col("new_doc") == F.col("document_id"), "left")
    end = F.coalesce(F.date_sub("new_from", 1), F.date_sub("document_date", 1))
    return pairs.select("place", "seq", "old_id", "new_id", "old_doc", "new_doc", F.when(F.col("time_varying") & F.col("valid_to").isNull(), end).alias("valid_to"))


def with_replaced_ends(facts: DataFrame, replaced: DataFrame) -> DataFrame:
    """``facts`` with the ends that replacements give them; of several for a fact the last chain's, a given end stays."""
    ends = replaced.where("valid_to is not null").groupBy("old_id").agg(F.max_by("valid_to", F.struct("place", "seq")).alias("__end"))
    return facts.join(ends, facts.id == ends.old_id, "left").withColumn("valid_to", F.coalesce("valid_to", "__end")).drop("__end", "old_id")


def resolve_replaced(conflicts: DataFrame, replaced: DataFrame) -> DataFrame:
    """Open conflicts that hold an old and its new fact become resolved_temporally, with the winner, loser and source
    documents of the first such pair in the order of chains and facts."""
    members = conflicts.where("status = 'open'").select("id", F.explode("competing_fact_ids").alias("member"))
    both = members.join(replaced, F.col("member") == F.col("old_id")).join(members.select(F.col("id").alias("__id"), F.col("member").alias("__m")), (F.col("id") == F.col("__id")) & (F.col("new_id") == F.col("__m")))
    pair = F.struct(F.col("new_id").alias("winner_fact_id"), F.col("old_id").alias("loser_fact_id"), F.lit("replaced_by").alias("source"), F.col("old_doc").alias("old_doc_id"), F.col("new_doc").alias("new_doc_id"))
    first = both.groupBy("id").agg(F.min_by(pair, F.struct("place", "seq")).alias("resolution"))
    return conflicts.join(first, "id", "left").withColumn("status", F.when(F.col("resolution").isNotNull(), F.lit("resolved_temporally")).otherwise(F.col("status")))


def _records(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the other columns of each key's rows as records, sorted by id."""
    others = [c for c in rows.columns if c not in ("id", key)]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", *others))).alias(name))


def _or_none(name: str, of: DataFrame) -> Column:
    return F.coalesce(name, F.array().cast(of.schema[name].dataType)).alias(name)


def conflict_details(conflicts: DataFrame, facts: DataFrame, all_claims: DataFrame) -> DataFrame:
    """(conflict_id, fact_id, canonical_value, claims) of each member: members that aren't there have no value, and
    claims are records sorted by id, none if there are none."""
    members = conflicts.select(F.col("id").alias("conflict_id"), F.explode("competing_fact_ids").alias("fact_id"))
    own = _records(all_claims, "fact_id", "claims")
    rows = members.join(facts.select(F.col("id").alias("fact_id"), "canonical_value"), "fact_id", "left").join(own, "fact_id", "left")
    return rows.select("conflict_id", "fact_id", "canonical_value", _or_none("claims", own))


#: Fixed value: what an id looks like.
ID = "^[0-9a-f]{64}$"


def by_id(table: DataFrame, *ids: str) -> DataFrame:
    """The rows with these ids; the filter reaches the Parquet scan. Whatever isn't a SHA-256 in lower case has none."""
    good = [i for i in ids if len(i) == 64 and not set(i) - set("0123456789abcdef")]
    return table.where(F.col("id").isin(good)) if good else table.limit(0)


def of_subject(facts: DataFrame, subject: str, predicate: str | None = None) -> DataFrame:
    rows = facts.where(F.col("subject_id") == subject)
    return rows if predicate is None else rows.where(F.col("predicate") == predicate)


def claims_of(all_claims: DataFrame, fact_id: str) -> DataFrame:
    return all_claims.where(F.col("fact_id") == fact_id)


def conflicts_with(conflicts: DataFrame, fact_id: str) -> DataFrame:
    return conflicts.where(F.array_contains("competing_fact_ids", fact_id))


def fact_details(facts: DataFrame, all_claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Each fact with the records of its claims and of the conflicts that hold it, sorted by id. A conflict's members are
    left to ``conflict_details``: each of its facts would repeat them all."""
    own = _records(all_claims, "fact_id", "claims").withColumnRenamed("fact_id", "__fact")
    about = conflicts.select(F.explode(F.array_distinct("competing_fact_ids")).alias("__fact"), *(c for c in conflicts.columns if c != "competing_fact_ids"))
    held = _records(about, "__fact", "conflicts")
    rows = facts.join(own, facts.id == own["__fact"], "left").drop("__fact").join(held, facts.id == held["__fact"], "left").drop("__fact")
    return rows.withColumns({"claims": _or_none("claims", own), "conflicts": _or_none("conflicts", held)})


def entity_snapshot(facts: DataFrame, entities: DataFrame, day: Column | None = None) -> DataFrame:
    """(entity_id, n_facts, facts) of each of ``entities`` (entity_id): its facts' sorted ids, those valid on ``day`` if
    one is given; an entity without facts has an empty list."""
    rows = as_of(facts, day) if day is not None else facts
    own = rows.groupBy("subject_id").agg(F.array_sort(F.collect_set("id")).alias("facts"))
    out = entities.join(own, entities.entity_id == own.subject_id, "left").select("entity_id", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))
    return out.select("entity_id", F.size("facts").cast("long").alias("n_facts"), "facts")


def totals(facts: DataFrame, all_claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row: how many facts, claims and conflicts there are, and how many of the latter are open."""
    one = lambda t, n: t.agg(F.count(F.lit(1)).alias(n))
    held = conflicts.agg(F.count(F.lit(1)).alias("conflicts"), F.count_if(F.col("status") == "open").alias("open_conflicts"))
    return one(facts, "facts").crossJoin(F.broadcast(one(all_claims, "claims"))).crossJoin(F.broadcast(held))  # one row each


def registered(predicates: DataFrame, order: str = "seq") -> DataFrame:
    """The contract of each predicate; the last registration of a name holds."""
    return keep_last(predicates, ["predicate"], order)


def confidence_category(value: Column) -> Column:
    """Old numeric confidences as categories; what is none stays as it is."""
    number = value.try_cast("double")
    return F.when(number.isNull(), value).when(number == 1.0, "deterministic").when(number >= 0.5, "llm_high").otherwise("llm_low")


def page(conflicts: DataFrame, status: str, limit: int) -> DataFrame:
    """The first ``limit`` conflicts of a status by id (a page is the feature), with the count of all of them."""
    chosen = conflicts.where(F.col("status") == status)
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    return chosen.orderBy("id").limit(limit).crossJoin(F.broadcast(total))
