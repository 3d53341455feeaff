"""Requests registered: inspections with all that belongs to them, numbered without gaps and committed as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import creation
from shelfmark.operators.ledger import Ledger, numbered


def register(ledger: Ledger, batch: str, requests: DataFrame, declared: DataFrame, stores: DataFrame, users: DataFrame, rule_table: DataFrame, more: dict[str, DataFrame] | None = None) -> bool:
    """Adds stores, inspections, declarations, violations and audit rows of ``requests`` to the ledger; False if the batch is there already.

    ``requests``: image_id (each once), officer_code, store_id, store_name, store_address, category, remarks; ``declared``:
    their declarations by image_id and field_name (columns of ``payloads.declared``); ``stores``: those that were there
    before the ledger, by store_id. Ids go on from what the ledger holds, so that a batch that failed and runs again
    gives its rows the same ids. Every child has its inspection's id. ``more`` tables are committed along with these.
    """
    if ledger.committed(batch):
        return False
    stage = lambda name: f"{ledger.root}/_staging/{batch}/{name}"
    start = {t: ledger.rows(t) + 1 for t in ("inspections", "declarations", "violations", "audits")}
    known = stores.select("store_id", "store_code", "store_name")
    known = known.unionByName(ledger.read("stores", known).select(known.columns)).hint("merge")  # a union drops its sides' hints
    last = known.agg(F.coalesce(F.max("store_id"), F.lit(0))).first()[0]
    new = numbered(creation.new_stores(requests, known), ["image_id"], "store_id", stage("stores"), last + 1)

    fields = declared.select("image_id", "field_name", F.col("detected_value").alias("value"), "raw_text", "status")
    brought = requests.drop("store_id").join(new.select("image_id", "store_id"), "image_id").unionByName(requests.join(known.select("store_id"), "store_id", "left_semi").select(requests.drop("store_id").columns + ["store_id"]))
    every = known.unionByName(new.select(known.columns)).hint("merge")
    made = creation.inspections(brought, fields, every, users).join(brought.select("image_id", "store_id", F.coalesce("remarks", F.lit(creation.REMARKS)).alias("remarks")), "image_id")
    inspections = numbered(made, ["image_id"], "inspection_id", stage("inspections"), start["inspections"])

    ids = inspections.select("image_id", "inspection_id")
    declarations = numbered(ids.join(declared.drop("raw_text", "status"), "image_id").drop("image_id"), ["inspection_id", "field_name"], "declaration_id",
                            stage("declarations"), start["declarations"])
    found = creation.violations(requests, fields, rule_table).join(ids, "image_id").drop("image_id", "inspection_number")
    violations = numbered(found, ["inspection_id", "place"], "violation_id", stage("violations"), start["violations"])
    audits = numbered(creation.audits(inspections, "inspection_id"), ["inspection_id"], "audit_id", stage("audits"), start["audits"])
    return ledger.publish(batch, {"stores": new, "inspections": inspections, "declarations": declarations, "violations": violations, "audits": audits} | (more or {}))
