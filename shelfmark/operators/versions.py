"""Rows that change, as an append-only log of their changes: the last version, any earlier one, and fewer files that say the same.

A log has a key, ``changed_at`` and ``change_id`` (together they order a key's changes), and the columns that change; a
null in one means that the change leaves it. What is folded is one value a key and column, with map-side sums, so a key
with most of all changes is no heavier than another.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ledger import Ledger

ORDER = ("changed_at", "change_id")


def as_of(log: DataFrame, key: str, at: datetime | None = None) -> DataFrame:
    """One row a key as it was at a time (that moment's changes included), or is now: of each column the last value that isn't null."""
    seen = log if at is None else log.where(F.col("changed_at") <= F.lit(at))
    order = F.struct(*ORDER)
    columns = [c for c in log.columns if c not in (key, *ORDER)]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return seen.groupBy(key).agg(*(last(c) for c in columns), F.max(order).alias("_last")).select(key, *(F.col(f"_last.{c}").alias(c) for c in ORDER), *columns)


def compacted(log: DataFrame, key: str, upto: datetime) -> DataFrame:
    """The log with the changes up to a time folded into one a key: read as of then or later, it gives the same."""
    return as_of(log, key, upto).select(log.columns).unionByName(log.where(F.col("changed_at") > F.lit(upto)))


def append(ledger: Ledger, batch: str, table: str, changes: DataFrame) -> bool:
    return ledger.publish(batch, {table: changes})


def compact(ledger: Ledger, batch: str, table: str, key: str, upto: datetime) -> bool:
    """Puts one batch in place of all that the table has; readers see the old ones until it is committed."""
    old = ledger.live(table)
    return ledger.publish(batch, {table: compacted(ledger.read(table), key, upto)}, {table: old})


def adjudicated(inspections: DataFrame, decisions: DataFrame, changed_at: Column) -> DataFrame:
    """Log rows of the decisions on inspections (what ``workflow.adjudicate`` gives for those acted on)."""
    done = decisions.where("supervisor_notes IS NOT NULL").join(inspections.select("inspection_id", changed_at.alias("changed_at")), "inspection_id")
    return done.select("inspection_id", "changed_at", F.lit(2).cast("long").alias("change_id"), "supervisor_status", "fee", "supervisor_notes")
