"""Mastery kept current on an attempt stream.

State per (student, skill) is one small value plus a buffer of rows still inside the delay. A
rule's step is its 2x2 matrix, the same that the batch operator multiplies. Chains are many and short, so
a chain costs rows and no data frame, and one read and one write of its state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from edupulse.operators.mastery import MasteryRule
from edupulse.session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Times travel as microseconds since the epoch.
_OUTPUT = "student_id long, topic_id string, kind string, mastery double, observation_count long, us long, event_id long, correct boolean"
_RESULT = Row(*[item.split()[0] for item in _OUTPUT.split(", ")])
_VALUE = "mastery double, n long, last_us long, last_id long, seen_us long"
_ROW = "us long, event_id long, correct boolean"


class MasteryProcessor(StatefulProcessor):
    """Applies a chain's attempts in (time, id) order.

    A row waits until the chain has seen a row ``delay_us`` later, or, with ``idle_ms`` set, until
    the chain has been quiet that long. The last applied row, delivered again, is dropped; an older
    row is reported as ``late``, never dropped or applied.
    """

    def __init__(self, matrices: dict[bool, tuple[float, ...]], initial: float, delay_us: int,
                 idle_ms: int | None) -> None:
        self.matrices, self.initial, self.delay_us, self.idle_ms = matrices, initial, delay_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", _VALUE)
        self.waiting = handle.getListState("waiting", _ROW)

    def _advance(self, key, new: list[tuple[int, int, bool]], buffered: list[tuple[int, int, bool]], all_ready: bool) -> Iterator[Row]:
        mastery, n, last_us, last_id, seen = self.value.get() or (self.initial, 0, -(2**62), -1, -(2**62))
        rows = sorted([*buffered, *new])
        seen = max(seen, rows[-1][0]) if rows else seen
        horizon = seen if all_ready else seen - self.delay_us
        keep, before = [], n
        for us, event_id, correct in rows:
            if (us, event_id) == (last_us, last_id):
                continue  # delivered again
            if (us, event_id) < (last_us, last_id):
                yield _RESULT(*key, "late", None, None, us, event_id, correct)
            elif us <= horizon:
                a, b, c, d = self.matrices[correct]
                mastery = min(1.0, max(0.0, (a * mastery + b) / (c * mastery + d)))
                n, last_us, last_id = n + 1, us, event_id
            else:
                keep.append((us, event_id, correct))
        self.value.update((mastery, n, last_us, last_id, seen))
        if keep:
            self.waiting.put(keep)
        elif buffered:
            self.waiting.clear()
        if n > before:
            yield _RESULT(*key, "state", mastery, n, last_us, None, None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["us"], r["event_id"], bool(r["correct"])) for r in rows]
        # Without a delay nothing ever waits.
        buffered = [tuple(r) for r in self.waiting.get()] if self.delay_us else []
        yield from self._advance(key, new, buffered, all_ready=self.delay_us == 0)
        if self.idle_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.waiting.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], [tuple(r) for r in self.waiting.get()], all_ready=True)

    def close(self) -> None:
        pass


def mastery_stream(
    attempt_stream: DataFrame, *, rule: MasteryRule, delay_seconds: float = 0.0,
    idle_seconds: float | None = None,
) -> DataFrame:
    """Rows of kind ``state`` (a chain's new mastery) and ``late`` (attempts that came after
    a later one was applied, for the caller's side table).

    Input columns: student_id, topic_id, ts, event_id, correct. With in-order input the last state
    per chain equals the batch result. ``idle_seconds`` releases the rows still waiting in quiet
    chains; it uses processing-time timers, so such a query runs until it is stopped.
    """
    spark = attempt_stream.sparkSession
    ship_package()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    matrices = {ok: tuple(map(float, rule.matrix(ok))) for ok in (True, False)}
    processor = MasteryProcessor(matrices, float(rule.initial), int(delay_seconds * 1e6),
        None if idle_seconds is None else int(idle_seconds * 1000))
    # A row without a time comes first, as in batch use.
    us = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(2**53)))
    rows = attempt_stream.select("student_id", "topic_id", us.alias("us"), "event_id", "correct")
    found = rows.groupBy("student_id", "topic_id").transformWithState(
        statefulProcessor=processor, outputStructType=_OUTPUT, outputMode="Update",
        timeMode="None" if idle_seconds is None else "ProcessingTime")
    return found.select(
        "student_id", "topic_id", "kind", "mastery", "observation_count", F.timestamp_micros("us").alias("updated_at"), "event_id", "correct")
