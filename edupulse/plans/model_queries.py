"""Queries that fit models or run streams; iterative, so most have no SQL counterpart."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edupulse.models import calibrate, classifiers as c, features as f
from edupulse.models.bootstrap import bootstrap_diff
from edupulse.operators import aggregates, clean, mastery, metrics, snapshots, splits, windows
from edupulse.plans import driver_tables as v
from edupulse.plans.experiment import TracingExperiment
from edupulse.plans.parameters import CANDIDATE_BKT
from edupulse.plans.queries import _course_tables, publish, query
from edupulse.session import ensure_checkpoint_dir, materialize
from edupulse.streaming.environment_stream import environment_stream
from edupulse.streaming.mastery_stream import mastery_stream
from edupulse.streaming.ordered_mastery import OrderedMastery
from edupulse.streaming.sinks import advance_sink, read_upserted, upsert_sink

# A short grid: the full one is 600 boosting rounds and a refit.
SHORT_GBT_GRID = ({"max_depth": 3, "learning_rate": 0.1, "max_iter": 10}, {"max_depth": 5, "learning_rate": 0.1, "max_iter": 10})


def _parameters(spark: SparkSession, rules: dict[str, mastery.BktRule]) -> DataFrame:
    rows = [(name, r.prior, r.transit, r.slip, r.guess) for name, r in rules.items()]
    return publish(spark.createDataFrame(rows, "step string, prior double, transit double, slip double, guess double"))


@query
def bkt_em_fit(spark, d):
    return _parameters(spark, {"fitted": calibrate.fit_bkt(v.attempts(spark, d), n_iter=20)})


@query
def bkt_em_step(spark, d):
    """One step from the starting point and one from the fitted defaults."""
    starts = {"from_initial": mastery.BktRule(*mastery.INITIAL_BKT), "from_default": mastery.BktRule()}
    return _parameters(spark, {name: calibrate.fit_bkt(v.attempts(spark, d), n_iter=1, initial=rule) for name, rule in starts.items()})


@query
def bkt_candidate_losses(spark, d):
    """Validation losses of fixed parameter sets, in one pass."""
    val = TracingExperiment(v.attempts(spark, d)).part("val")
    return publish(calibrate.candidate_losses(val, [mastery.BktRule(*p) for p in CANDIDATE_BKT]))


@query
def bkt_selection(spark, d):
    chosen = TracingExperiment(v.attempts(spark, d)).tracing
    losses = spark.createDataFrame(
        [(n, loss, n == chosen.n_iter) for n, loss in chosen.val_log_loss.items()],
        "n_iter int, val_log_loss double, selected boolean")
    return publish(losses)


@query
def kt_lr(spark, d):
    return publish(TracingExperiment(v.attempts(spark, d)).report(boosted=False))


@query
def kt_gbt(spark, d):
    experiment = TracingExperiment(v.attempts(spark, d), iterations=(5,), gbt_candidates=SHORT_GBT_GRID)
    model, _, _ = experiment.boosted
    rows = c.score(model, windows.kt_vector(experiment.features.where("split = 'test'"), policy="linear"))
    return publish(metrics.evaluate_predictions(rows))


@query
def bootstrap_ci(spark, d):
    rows = mastery.bkt_trajectory(v.attempts(spark, d)).withColumnRenamed("predicted", "challenger")
    other = mastery.BktRule(*mastery.INITIAL_BKT)
    rows = rows.withColumn("reference", other.predict(F.col("mastery_before")))
    return publish(bootstrap_diff(rows))


def _split_snapshot(snapshot: DataFrame, label: str, key) -> DataFrame:
    """The snapshot, written once, with its split: range bounds are sampled, which would make it twice."""
    snapshot = materialize(snapshot)
    return splits.stratified_split(snapshot, label=label, key=key)


def _report(model, rows: DataFrame, target: str) -> DataFrame:
    return publish(metrics.classification_report(c.score(model, rows).withColumn("label", F.col(target))))


@query
def dropout_lr(spark, d):
    rows = _split_snapshot(snapshots.dropout_snapshot(*_course_tables(spark, d)), "is_dropout", "id_student")
    model = c.fit_logistic(rows.where("split = 'train'"), features=f.DROPOUT)
    return _report(model, rows.where("split = 'test'"), "is_dropout")


@query
def dropout_threshold(spark, d):
    snapshot = snapshots.dropout_snapshot(*_course_tables(spark, d), cutoff_day=45)
    rows = _split_snapshot(snapshot, "is_dropout", "id_student")
    model = c.fit_forest(rows.where("split = 'train'"), features=f.DROPOUT)
    scored = c.score(model, rows.where("split = 'val'")).withColumn("label", F.col("is_dropout"))
    return publish(metrics.threshold_sweep(scored))


@query
def performance_rf(spark, d):
    rows = _split_snapshot(snapshots.performance_snapshot(*_course_tables(spark, d)), "is_pass", "id_student")
    model = c.fit_forest(rows.where("split = 'train'"), features=f.PERFORMANCE)
    return _report(model, rows.where("split = 'test'"), "is_pass")


@query
def attendance_lr(spark, d):
    rows = snapshots.attendance_snapshot(v.attendance(spark, d), threshold=0.3)
    rows = _split_snapshot(rows, "is_high_absence_day", ["school_id", "attendance_date"])
    model = c.fit_logistic(rows.where("split = 'train'"), features=f.ATTENDANCE)
    return _report(model, rows.where("split = 'test'"), "is_high_absence_day")


@query
def occupancy_lr(spark, d):
    readings = v.room_readings(spark, d)
    rows = splits.chronological_split(readings, order_by=["recorded_at", "event_id"])
    rows = windows.transitions(rows, key=["source_file"], order=["recorded_at", "event_id"], value="occupancy")
    model = c.fit_logistic(rows.where("split = 'train'"), features=f.OCCUPANCY)
    scored = c.score(model, rows.where("split = 'test'")).withColumn("label", F.col("occupancy"))
    return publish(metrics.transition_report(scored))


@query
def absence_risk_lr(spark, d):
    snapshot = snapshots.absence_snapshot(v.absence_records(spark, d))
    training = clean.drop_content_duplicates(snapshot, id_col="record_id").withColumn(
        "is_high_absence_risk", clean.is_absence_bucket())
    rows = _split_snapshot(training, "is_high_absence_risk", "record_id")
    model = c.fit_logistic(rows.where("split = 'train'"), features=f.ABSENCE)
    return _report(model, rows.where("split = 'test'"), "is_high_absence_risk")


@query
def heldout_serving(spark, d):
    snapshot = snapshots.dropout_snapshot(*_course_tables(spark, d))
    rows = _split_snapshot(snapshot, "is_dropout", "id_student")
    model = c.fit_logistic(rows.where("split = 'train'"), features=f.DROPOUT)
    keys = aggregates.ENROLLMENT
    served = c.serve_heldout(v.enrollments(spark, d), c.score(model, rows), keys=keys)
    return publish(served.select(*keys, "prob", "predicted_class", "withheld_reason"))


@query
def out_of_fold(spark, d):
    snapshot = materialize(snapshots.dropout_snapshot(*_course_tables(spark, d)))
    scored = c.out_of_fold(
        snapshot, lambda rows: c.fit_logistic(rows, features=f.DROPOUT), folds=3, key="id_student")
    return publish(scored.select("id_student", "fold", "prob", "predicted_class"))


# --- streams, run over the events as one bounded stream ------------------------------------------


def _work_dir(spark: SparkSession) -> str:
    """A fresh folder next to the session's checkpoints, which every executor can reach."""
    base = ensure_checkpoint_dir(spark)
    if "://" in base and not base.startswith("file:"):
        from uuid import uuid4
        return f"{base.rstrip('/')}/stream-{uuid4().hex}"
    return tempfile.mkdtemp(prefix="stream-", dir=base.removeprefix("file:"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = v.table(spark, d, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
            .withColumn("ts", F.col("ts").cast("timestamp")))


def _attempt_stream(spark: SparkSession, d: str) -> DataFrame:
    return _event_stream(spark, d).select(
        F.col("user_id").alias("student_id"), F.col("event_type").alias("topic_id"), "ts", "event_id",
        (F.col("value") >= 30).alias("correct"))


@query
def stream_mastery(spark, d):
    work = _work_dir(spark)
    stream = mastery_stream(_attempt_stream(spark, d), rule=mastery.BktRule())
    upsert_sink(stream, f"{work}/out", keys=mastery.CHAIN_KEYS, order_by=["observation_count"],
                checkpoint=f"{work}/progress", where="kind = 'state'", side_path=f"{work}/late").awaitTermination()
    states = read_upserted(spark, f"{work}/out", keys=mastery.CHAIN_KEYS)
    return publish(states.select("student_id", "topic_id", "mastery", "observation_count", "updated_at"))


@query
def stream_advance(spark, d):
    work = _work_dir(spark)
    advance_sink(_attempt_stream(spark, d), f"{work}/out", rule=mastery.BktRule(),
                 checkpoint=f"{work}/progress").awaitTermination()
    states = read_upserted(spark, f"{work}/out", keys=mastery.CHAIN_KEYS)
    return publish(states.select("student_id", "topic_id", "mastery", "observation_count", "updated_at"))


def _ordered(spark: SparkSession, d: str) -> OrderedMastery:
    """The attempts in four arrivals by time. Every eleventh comes one arrival late, every thirteenth comes
    again with the next; the watermark is half an arrival behind. Each arrival is a run of the same query, resumed
    from its checkpoint, so the micro-batches are four."""
    work, rows = _work_dir(spark), v.attempts(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.unix_micros("ts")
    low, high = rows.agg(F.min(us), F.max(us)).first()
    keyed = OrderedMastery(spark, f"{work}/state", rows.schema, rule=mastery.BktRule(), delay_seconds=((high or 0) - (low or 0)) // 8 / 1e6,
                           remember_seconds=((high or 0) - (low or 0)) / 1e6, compact_every=3)
    if low is None:
        return keyed
    home = F.floor((us - low) * 4 / (high - low + 1)) + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    home = F.least(home, F.lit(3))
    # One write, partitioned by arrival: a row's first delivery, and its second.
    again = F.when(F.col("event_id") % 13 == 0, F.array(home, F.least(home + 1, F.lit(3)))).otherwise(F.array(home))
    rows.withColumn("arrival", F.explode(again)).write.partitionBy("arrival").parquet(f"{work}/all")
    for arrival in range(4):
        spark.read.schema(rows.schema).parquet(f"{work}/all/arrival={arrival}").write.mode("append").parquet(f"{work}/in")
        keyed.start(spark.readStream.schema(rows.schema).parquet(f"{work}/in"), checkpoint=f"{work}/progress").awaitTermination()
    keyed.finish()
    return keyed


@query
def stream_ordered(spark, d):
    return publish(_ordered(spark, d).states())


@query
def stream_late(spark, d):
    return publish(_ordered(spark, d).late())


@query
def stream_environment(spark, d):
    work = _work_dir(spark)
    readings = _event_stream(spark, d).select(
        F.concat(F.lit("CO2_0"), (F.col("user_id") % 6 + 1).cast("string")).alias("sensor_id"),
        F.col("ts").alias("recorded_at"), "event_id", F.col("value").alias("temperature_c"),
        (F.col("event_id") % 100).cast("double").alias("humidity_pct"),
        F.floor(F.col("value") * 10 + 400).alias("co2_ppm"),
        (F.col("event_id") % 101).cast("double").alias("battery_pct"))
    upsert_sink(environment_stream(readings, tie_break=("event_id",)), f"{work}/out", keys=["sensor_id"],
                order_by=["reading_count"], checkpoint=f"{work}/progress").awaitTermination()
    return publish(read_upserted(spark, f"{work}/out", keys=["sensor_id"]))
