"""Review actions as a stream, with the state machine's outcome per action.

The status of an exception follows from its first start and its first decision.
These two are the keyed state of the stream, kept in the state store: a batch
reads and writes the state of the exceptions that it touches, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyweave.streaming.watch import save

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "start long, decision long, outcome string"
JUDGED = "exception_id string, seq long, action string, valid boolean, status_after string"
DECISIONS = ("approved", "rejected")


class _Reviews(StatefulProcessor):
    """Judges the actions of one exception in the order of the log."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("review", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, decision, outcome = self.state.get() if self.state.exists() else (None, None, None)
        known = (start, decision)
        actions = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        out = []
        for seq, action in zip(actions["seq"].tolist(), actions["action"].tolist(), strict=True):
            valid = False
            if action == "review_start" and start is None:
                valid, start = decision is None, seq
            elif action in DECISIONS and decision is None:
                valid, decision, outcome = True, seq, action
            elif action == "sign_off":
                valid = decision is not None
            status = outcome if decision is not None else "reviewed" if start is not None else "pending"
            out.append((key[0], seq, action, valid, status))
        if (start, decision) != known:
            self.state.update((start, decision, outcome))
        yield pd.DataFrame(out, columns=["exception_id", "seq", "action", "valid", "status_after"])

    def close(self) -> None:
        pass


def judged_stream(actions: DataFrame) -> DataFrame:
    """``exception_id, seq, action`` stream -> the same with validity and the status reached.

    ``seq`` is the order of the log that the actions are read from; no batch holds
    an action earlier than one of a batch before. Needs the RocksDB state store (:data:`STORE`).
    """
    lean = actions.select("exception_id", F.col("seq").cast("long").alias("seq"), "action").filter(F.col("exception_id").isNotNull())
    return lean.groupBy("exception_id").transformWithStateInPandas(_Reviews(), JUDGED, "append", "none")


def review_stream(actions: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Judge a stream of actions into ``root/judged``, with the invalid ones apart in ``root/invalid``."""
    spark = actions.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        save(kept, f"{root}/judged", batch_id)
        save(kept.filter("NOT valid"), f"{root}/invalid", batch_id)
        kept.unpersist()

    writer = judged_stream(actions).writeStream.outputMode("append").foreachBatch(each)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
