"""Facts and claims from given model responses about addresses, birthdates, employers, diagnoses and medication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import facts as O
from .dates import iso_date, valid_birthdate

#: The tags of documents that each predicate is looked for in, and the names of a response's fields.
TRIGGERS = {
    "address": ("proposition_assurance", "invoice", "tax_notice", "identity", "compromis_vente", "bulletin_paie", "proof_of_address", "administrative", "legal", "healthcare"),
    "birthdate": ("identity", "passport", "tax_notice", "bulletin_paie", "birth_certificate", "healthcare"),
    "employer": ("bulletin_paie", "contrat_travail", "tax_notice", "cv", "attestation_emploi"),
    "diagnosis": ("healthcare", "medical_record"),
    "prescribed_medication": ("healthcare", "medical_record", "prescription"),
}
FIELDS = {"address": ("entity_name", "address_text"), "birthdate": ("entity_name", "birthdate_iso"), "employer": ("employee_name", "employer_name"),
          "diagnosis": ("patient_name", "diagnosis"), "prescribed_medication": ("patient_name", "medication")}
PLACES = {"prescribed_medication": "medication"}
ADDRESS = r"(?U)^\s*\d{1,4}[\w\s,.\-'À-ÿ]+?\d{4,5}\s*[A-Z]{0,2}\s+[\w\-'À-ÿ][\w\s\-'À-ÿ]*$"


def triggered(tags: Column, predicate: str) -> Column:
    """Whether a document with these tags is looked at for the predicate."""
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, TRIGGERS[predicate]))), F.lit(False))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def valid_address(text: Column) -> Column:
    """Number and street, then a postal code of four or five digits and a city."""
    return collapsed(text).rlike(ADDRESS)


def canonical_address(components: Column, text: Column) -> Column:
    """'<street>, <code> <city>' where all three are given, else the text on one line."""
    part = lambda k: F.trim(F.coalesce(F.get_json_object(components, f"$.{k}"), F.lit("")))
    street, code, city = part("street"), part("postal_code"), part("city")
    return F.when((street != "") & (code != "") & (city != ""), F.concat(street, F.lit(", "), code, F.lit(" "), city)).otherwise(collapsed(text))


def extracted(responses: DataFrame, predicate: str) -> DataFrame:
    """Facts with their claim's id and place of the (document_id, document_date, response) of one predicate: an item of
    a response needs both of its fields. Names of patients are told apart by their documents."""
    who, what = FIELDS[predicate]
    items = responses.select("document_id", "document_date", F.posexplode(T.json_objects(F.col("response"))).alias("at", "item"))
    field = lambda k: F.trim(F.coalesce(F.get_json_object("item", f"$.{k}"), F.lit("")))
    rows = items.select("*", field(who).alias("who"), field(what).alias("what")).where("who <> '' and what <> ''")
    day = F.col("document_date").cast("date")
    begins, ends, sure = day, F.lit(None).cast("date"), F.lit(False)
    value = F.col("what")
    if predicate == "address":
        value, sure = canonical_address(F.get_json_object("item", "$.components"), F.col("what")), valid_address(F.col("what"))
    elif predicate == "birthdate":
        begins, sure = F.lit(None).cast("date"), valid_birthdate(F.col("what"))
    elif predicate == "employer":
        value, sure = collapsed(F.col("what")), F.lit(True)
        begins = F.coalesce(iso_date(F.get_json_object("item", "$.period_start_iso")), day)
        ends = iso_date(F.get_json_object("item", "$.period_end_iso"))
    else:
        value = F.trim(F.lower("what"))
    name = F.concat_ws(" ", "who", "document_id") if who == "patient_name" else F.col("who")
    place = F.concat(F.lit(PLACES.get(predicate, predicate) + ":"), F.col("at").cast("string"))
    rows = rows.select(T.subject_id(name).alias("subject_id"), F.lit(predicate).alias("predicate"), value.alias("canonical_value"), F.col("document_id").alias("source_doc_id"), begins.alias("valid_from"), ends.alias("valid_to"),
                       F.when(sure, "llm_high").otherwise("llm_low").alias("confidence"), "item", place.alias("source_location"))
    rows = O.with_fact_id(rows)
    return rows.withColumn("claim_id", F.sha2(F.concat_ws("|", "id", "source_doc_id", "source_location", F.lit(f"pack:{predicate}@0.3.0")), 256))


def run(documents: DataFrame, responses: DataFrame, stored_ids: DataFrame, predicates: tuple[str, ...] = tuple(TRIGGERS)) -> DataFrame:
    """New facts, each id once, from the responses (document_id, predicate, response) to the documents (document_id,
    document_date, doc_context) that the predicates are looked for in; those of ``stored_ids`` (id) are there already,
    so another run adds nothing."""
    out = None
    for p in predicates:
        asked = documents.where(triggered(F.col("doc_context"), p)).join(responses.where(F.col("predicate") == p).select("document_id", "response"), "document_id")
        rows = extracted(asked, p)
        out = rows if out is None else out.unionByName(rows)
    return O.keep_first(out, ["id"], "source_location").join(stored_ids.select("id"), "id", "left_anti")
