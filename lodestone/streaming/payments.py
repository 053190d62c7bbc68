"""The payment state machine as a stream: state per invoice, and a timer that expires what stays pending."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.payments import EXPIRY_HOURS, RESULT, STATES

#: State stores that timers and value states need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS = EXPIRY_HOURS * 3600 * 1000


class PaymentMachine(StatefulProcessor):
    """Value state: status and creation in milliseconds. Map state: event ids that were taken, so that a second delivery does nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.payment = handle.getValueState("payment", "status string, created long")
        self.taken = handle.getMapState("taken", "event_id long", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (invoice,) = key
        out: list[tuple] = []
        status, created = self.payment.get() if self.payment.exists() else (None, None)
        before = (status, created)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # one invoice's events of one batch
        for event_id, ts, kind in zip(batch["event_id"].tolist(), batch["ts"], batch["type"]):
            if self.taken.containsKey((event_id,)):
                continue
            now = int(ts.timestamp() * 1000)
            self.taken.updateValue((event_id,), (now,))
            if status == "pending" and now >= created + DAY_MS:
                out.append((invoice, None, pd.Timestamp(created + DAY_MS, unit="ms"), "expired", "failed"))
                status = "failed"
            status, created, outcome = self.step(status, created, kind, now)
            out.append((invoice, event_id, ts, outcome, status))
        if (status, created) != before:
            self.payment.update((status, created))
        if before[1] is None and created is not None and status == "pending":
            self.handle.registerTimer(created + DAY_MS)
        yield framed(out)

    @staticmethod
    def step(status: str | None, created: int | None, kind: str, now: int) -> tuple[str | None, int | None, str]:
        """Status and creation after an event, and what it did."""
        if kind == "created":
            return ("pending", now, "created") if created is None else (status, created, "duplicate")
        if kind not in STATES:
            return status, created, "ignored"
        if created is None:
            return status, created, "unknown"
        if kind == "payment.success":
            return "completed", created, "repeat" if status == "completed" else "completed"
        return "failed", created, "failed"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, created = self.payment.get()
        out = []
        if status == "pending":
            self.payment.update(("failed", created))
            out.append((key[0], None, pd.Timestamp(created + DAY_MS, unit="ms"), "expired", "failed"))
        yield framed(out)

    def close(self) -> None:
        pass


def framed(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["invoice", "event_id", "ts", "outcome", "state"])
    return df.astype({"event_id": "Int64", "ts": "datetime64[us]"})


def payment_history(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The outcomes of ``operators.payments.payment_history`` as events arrive; expiries come once the watermark passes them.

    Events of a batch are taken in order of time; an event that is later than the watermark by then is dropped by Spark only
    where it would need closed state, so input that is in order across batches gives the batch result. State is kept per
    invoice; the ids of its events are kept with it.
    """
    keyed = events.select("invoice", "event_id", "ts", "type").withWatermark("ts", late)
    return keyed.groupBy("invoice").transformWithStateInPandas(statefulProcessor=PaymentMachine(), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
