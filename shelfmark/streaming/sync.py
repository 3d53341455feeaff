"""Offline submissions as a stream: each is created once, however often and however late a client sends it again.

What has been answered is kept as state by offline id, for as long as a client may still send it again; no watermark
bounds it. What a micro-batch creates goes into the registry's tables and the quarantine as one batch of the ledger, named
by the micro-batch, so that a batch that fails between two tables and runs again has each row once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.operators import creation, payloads
from shelfmark.operators.ledger import Ledger
from shelfmark.operators.registration import register

#: State by key needs a store on disk; a batch without rows would only look for state that has had its time, without end.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
KEPT_DAYS = 365  # how long a client may take to send a submission again
ANSWERS = "offline_id long, payload string, error string, number string, first_sent timestamp, is_repeat boolean"


class FirstAnswer(StatefulProcessor):
    """Of each offline id the first submission that can be created, with its number; of any further one that number, and that it is a repeat.

    What can't be created is passed on without a number and is not remembered, so that it may be sent again in a better form.
    """

    def __init__(self, kept_days: int = KEPT_DAYS):
        self.kept_ms = kept_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "number string, sent timestamp", self.kept_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(rows).sort_values(["sent_at", "payload"], kind="stable", na_position="last")
        bad, good = batch[batch["error"].notna()], batch[batch["error"].isna()]
        told = lambda part, number, sent, repeats: pd.DataFrame(
            {"offline_id": part["offline_id"], "payload": part["payload"], "error": part["error"], "number": number, "first_sent": sent, "is_repeat": repeats})
        if len(bad):
            yield told(bad, None, bad["sent_at"], False)
        if len(good):
            known = self.first.get() if self.first.exists() else None
            first = known or (good["number"].iloc[0], good["sent_at"].iloc[0].to_pydatetime())
            if known is None:
                self.first.update(first)
            yield told(good, first[0], first[1], [known is not None or i > 0 for i in range(len(good))])

    def close(self) -> None:
        pass


def answered(submissions: DataFrame, kept_days: int = KEPT_DAYS) -> DataFrame:
    """``submissions``, a stream of offline_id, payload and sent_at (timestamp), each with the number first given to its id and whether it is a repeat.

    Of several that come together the earliest is the first. A submission without an id can't be created. State is dropped
    ``kept_days`` after the first one came.
    """
    error = F.coalesce(payloads.error(F.try_parse_json("payload")), F.when(F.col("offline_id").isNull(), "NO_ID"))
    asked = submissions.select("offline_id", "payload", "sent_at", error.alias("error"), creation.inspection_number(F.col("offline_id")).alias("number"))
    return asked.groupBy("offline_id").transformWithStateInPandas(statefulProcessor=FirstAnswer(kept_days), outputStructType=ANSWERS, outputMode="append", timeMode="processingTime")


def register_batch(ledger: Ledger, batch_id: int, answers: DataFrame, stores: DataFrame, users: DataFrame, rule_table: DataFrame) -> bool:
    """One micro-batch of ``answered`` into the ledger: what is new and can be created, with its children; what can't be, in ``quarantine``; and all answers in ``sync_results``."""
    name = f"sync-{batch_id:012d}"
    if ledger.committed(name):
        return False
    inbox = f"{ledger.root}/_staging/{name}/inbox"
    answers.write.mode("overwrite").parquet(inbox)  # the state is stepped once, whatever is read below
    answers = ledger.spark.read.parquet(inbox)
    if answers.isEmpty():
        return False
    good = payloads.checked(answers.where("error IS NULL AND NOT is_repeat").select("offline_id", "payload"))
    declared = payloads.declared(payloads.entries(good)).withColumnRenamed("offline_id", "image_id")
    quarantine = answers.where("error IS NOT NULL").select("offline_id", "payload", "error")
    status = F.when(F.col("error").isNull(), "SYNCED").otherwise("FAILED")
    told = answers.select("offline_id", F.col("number").alias("server_inspection_number"), "error", status.alias("status"), "is_repeat")
    return register(ledger, name, good.withColumnRenamed("offline_id", "image_id").drop("payload", "error"), declared, stores, users, rule_table, {"quarantine": quarantine, "sync_results": told})


def start(stream: DataFrame, ledger: Ledger, checkpoint: str, stores: DataFrame, users: DataFrame, rule_table: DataFrame, before: Callable[[int], None] | None = None):
    """Starts registering ``answered`` submissions, takes what is there and ends. ``before`` is called with each batch's id."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if before:
            before(batch_id)
        register_batch(ledger, batch_id, batch, stores, users, rule_table)

    conf = stream.sparkSession.conf
    held = {key: conf.get(key, None) for key in SETTINGS}
    try:  # a query keeps the settings that it began with
        for key, value in SETTINGS.items():
            conf.set(key, value)
        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in held.items():
            conf.unset(key) if value is None else conf.set(key, value)
