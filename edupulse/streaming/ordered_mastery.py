"""Mastery of an out-of-order attempt stream, applied in event order behind a watermark.

The watermark is the newest event time of all batches so far less ``delay_seconds``; it never falls. A row waits in a buffer until the
watermark has passed it, then all rows that are ready are folded in (time, id) order by the batch operator, from the stored state
of their chain: a hot chain is folded as in batch use, and no chain is a list in a Python process.

- A row whose (student, skill, time, id) was seen before is a redelivery and is dropped. Rows are remembered until they are
  ``remember_seconds`` behind the watermark, waiting rows always.
- A row that comes before the last applied row of its chain cannot be applied any more. It goes to the side table
  ``late``, once, and never into a state. A row without a time comes before all others.
- ``finish`` ends a bounded run: what still waits is applied as if the watermark had passed it.

A batch writes its rows and the waiting ones once, by what became of them (``applied``, ``late``, ``waiting``), under its own number. Rows after
the newest applied time cannot be late and are compared with waiting rows only; the others meet the remembered rows of their span of time.
Everything becomes visible with the commit of the keyed state, so a replayed batch gives the same tables. The cost of a batch
follows its own rows, the buffer and the chains that it touches, not the age of the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from edupulse.operators.advance import advance_mastery
from edupulse.operators.mastery import CHAIN_KEYS, MasteryRule
from edupulse.operators.sizes import in_even_tasks
from edupulse.streaming.keyed_state import Commit, KeyedState

IDENTITY = (*CHAIN_KEYS, "ts", "event_id")
_FAR = 2**62
# Folders of remembered rows that a batch may have to read; more are merged into one.
_PARTS = 16


def _micros(ts: str) -> Column:
    """The time of a row, with rows without one before all others."""
    return F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-_FAR))


class OrderedMastery:
    """The stored states, the buffer and the side table of one stream under ``path``.

    ``attempts``: schema of the rows (student_id, topic_id, ts, event_id, correct).
    """

    def __init__(self, spark: SparkSession, path: str, attempts: T.StructType, *, rule: MasteryRule, delay_seconds: float,
                 remember_seconds: float = 0.0, **state) -> None:
        self.spark, self.path, self.rule = spark, path.rstrip("/"), rule
        self.delay, self.remember = int(delay_seconds * 1e6), int(remember_seconds * 1e6)
        self.rows = T.StructType([attempts[c] for c in (*IDENTITY, "correct")])
        schema = T.StructType([
            *[attempts[k] for k in CHAIN_KEYS], T.StructField("mastery", T.DoubleType()), T.StructField("observation_count", T.LongType()),
            T.StructField("updated_at", attempts["ts"].dataType), T.StructField("last_id", attempts["event_id"].dataType)])
        self.state = KeyedState(spark, f"{self.path}/state", schema=schema, keys=CHAIN_KEYS, **state)

    def _part(self, version: int) -> str:
        return f"{self.path}/rows/version={version}"

    def _read(self, versions: Sequence[int], where: str) -> DataFrame:
        """The rows that these batches wrote, of some kinds."""
        if not versions:
            return self.spark.createDataFrame([], self.rows)
        schema = T.StructType([*self.rows.fields, T.StructField("version", T.LongType()), T.StructField("kind", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*[self._part(v) for v in versions])
        return rows.where(where).select(*self.rows.names)

    def states(self) -> DataFrame:
        return self.state.read().drop("last_id")

    def late(self) -> DataFrame:
        """Rows that came after a later row of their chain was applied."""
        return self._read(self.state.last_commit().extra.get("late", []), "kind = 'late'")

    def waiting(self) -> DataFrame:
        return self._waiting(self.state.last_commit())

    def _waiting(self, commit: Commit) -> DataFrame:
        return self._read([commit.version] if commit.version >= 0 else [], "kind = 'waiting'")

    def _settled(self, commit: Commit) -> DataFrame:
        """Applied and late rows that are still remembered."""
        versions = [part["version"] for part in commit.extra.get("settled", [])]
        merged = [part["version"] for part in commit.extra.get("settled", []) if part["merged"]]
        # A merged part holds its own batch's rows too.
        found = self._read(versions, f"CASE WHEN version IN ({', '.join(map(str, merged)) or 'NULL'}) THEN kind = 'merged' ELSE kind IN ('applied', 'late') END")
        return found.where(_micros("ts") > F.lit(commit.extra["watermark"] - self.remember))

    def _unseen(self, new: DataFrame, waiting: DataFrame, settled: DataFrame, rows: int) -> DataFrame:
        """New and waiting rows (``_waits``), each once and as first delivered, without those that are settled."""
        parts = [df.select(*self.rows.names, F.lit(rank).alias("_rank")) for rank, df in enumerate((new, waiting, settled))]
        found = in_even_tasks(parts[0].unionByName(parts[1]).unionByName(parts[2]), IDENTITY, rows)
        of_rank = [F.max(F.when(F.col("_rank") == rank, F.col("correct"))).alias(f"_correct{rank}") for rank in (0, 1)]
        found = found.groupBy(*IDENTITY).agg(F.max("_rank").alias("_rank"), *of_rank).where("_rank < 2")
        waits = F.col("_rank") == 1
        return found.select(*IDENTITY, F.when(waits, F.col("_correct1")).otherwise(F.col("_correct0")).alias("correct"), waits.alias("_waits"))

    def _is_late(self, rows: DataFrame, stored: DataFrame) -> DataFrame:
        """``rows`` with ``_late``: they come before the last applied row of their chain."""
        marks = stored.select(*[F.col(k).alias(f"_{k}") for k in CHAIN_KEYS], F.col("updated_at").alias("_at"), F.col("last_id").alias("_id"), F.lit(True).alias("_any"))
        same = F.lit(True)
        for k in CHAIN_KEYS:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        before = (F.col("ts") < F.col("_at")) | ((F.col("ts") == F.col("_at")) & (F.col("event_id") <= F.col("_id"))) | (F.col("ts").isNull() & F.col("_any"))
        found = rows.join(marks, same, "left")
        return found.select(*rows.columns, (~F.col("_waits") & F.coalesce(before, F.lit(False))).alias("_late"))

    def apply(self, batch: DataFrame, version: int, *, flush: bool = False) -> None:
        """One micro-batch. Versions ascend; the same version again replaces what it wrote before. ``batch`` is evaluated up to three times."""
        old = self.state.last_commit(before=version)
        new, waiting, us = batch.select(*self.rows.names), self._waiting(old), _micros("ts")
        # Redeliveries are no newer than what came before, so they need not be known here.
        is_new = [df.select(*CHAIN_KEYS, us.alias("_us"), F.lit(n).alias("_new")) for df, n in ((new, True), (waiting, False))]
        of_new = F.when(F.col("_new"), F.col("_us"))
        seen = is_new[0].unionByName(is_new[1]).agg(
            F.min(of_new).alias("low"), F.max(of_new).alias("high"), F.min("_us").alias("first"), F.max("_us").alias("last"),
            F.count(F.lit(1)).alias("n"), F.collect_set(self.state.bucket()).alias("buckets")).first()
        newest = -_FAR if seen["high"] is None else max(seen["high"] - self.delay, -_FAR)
        mark = max(old.extra.get("watermark", -_FAR), newest, _FAR if flush else -_FAR)
        # A flush applies what waits; it does not tell the time.
        kept_mark = max(old.extra.get("watermark", -_FAR), newest)
        # No row after this time was applied.
        reach = old.extra.get("reach", -_FAR - 1)
        stored = self.state.read(old, buckets=seen["buckets"])

        nothing = self.spark.createDataFrame([], self.rows)
        if seen["high"] is None:
            placed = waiting.withColumn("_late", F.lit(False))
        else:
            after, upto = us > F.lit(reach), us <= F.lit(reach)
            placed = self._unseen(new.where(after), waiting.where(after), nothing, seen["n"]).withColumn("_late", F.lit(False))
            if seen["first"] <= reach:
                settled = self._settled(old).where(upto & (us >= F.lit(seen["low"])))
                n = seen["n"] + sum(part["rows"] for part in old.extra.get("settled", []))
                earlier = self._unseen(new.where(upto), waiting.where(upto), settled, n)
                placed = placed.unionByName(self._is_late(earlier, stored))
        kind = F.when(F.col("_late"), "late").when(us <= F.lit(mark), "applied").otherwise("waiting")
        placed.select(*self.rows.names, kind.alias("kind")).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").partitionBy("kind").parquet(self._part(version))

        changed = advance_mastery(stored, self._read([version], "kind = 'applied'"), self.rule, last_id="last_id")
        late = [v for v in old.extra.get("late", []) if v < version]
        if self.state.exists(f"{self._part(version)}/kind=late"):
            late.append(version)
        reach = max(reach, min(mark, -_FAR if seen["last"] is None else seen["last"]))
        settled = [*old.extra.get("settled", []), {"version": version, "reach": reach, "rows": seen["n"], "merged": False}]
        extra = {"watermark": kept_mark, "reach": reach, "late": late, "settled": [p for p in settled if p["reach"] > kept_mark - self.remember]}
        self.state.publish(version, changed, self._merged(version, extra))

    def _merged(self, version: int, extra: dict) -> dict:
        """``extra`` with its many parts of remembered rows written as one."""
        if len(extra["settled"]) <= _PARTS:
            return extra
        rows = self._settled(Commit(version, extra=extra))
        rows.write.mode("overwrite").parquet(f"{self._part(version)}/kind=merged")
        n = self._read([version], "kind = 'merged'").count()
        return extra | {"settled": [{"version": version, "reach": extra["reach"], "rows": n, "merged": True}]}

    def finish(self) -> None:
        """Applies all waiting rows. Rows of these chains that come later still are late."""
        commit: Commit = self.state.last_commit()
        if commit.version >= 0:
            self.apply(self.spark.createDataFrame([], self.rows), commit.version + 1, flush=True)

    def start(self, attempt_stream: DataFrame, *, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Runs ``apply`` on every micro-batch. Versions are even, so that a flush fits in between."""
        writer = attempt_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: self.apply(batch, 2 * number))
        return writer.trigger(**(trigger or {"availableNow": True})).start()
