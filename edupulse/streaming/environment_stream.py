"""Running environment summary per sensor."""

from __future__ import annotations

from pyspark.sql import DataFrame

from edupulse.operators.summaries import environment_summary


def environment_stream(reading_stream: DataFrame, *, key: str = "sensor_id", tie_break: tuple[str, ...] = ()) -> DataFrame:
    """A11 on a stream of readings; run it in update mode. The aggregate combines before the
    shuffle, so a busy sensor is one row per task and micro-batch."""
    return environment_summary(reading_stream, key=key, tie_break=tie_break)
