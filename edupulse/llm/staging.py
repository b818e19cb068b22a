"""Small helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edupulse.session import ensure_checkpoint_dir

# Text that one step inside a task takes at a time; bounds the Python memory of a task.
STEP_BYTES = 8 << 20


def stage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs its running tasks, never the steps before.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_library(spark: SparkSession) -> None:
    """Sends this package to the Python workers, for clusters whose executors hold no copy of it."""
    sent = getattr(ship_library, "sent", None)
    context = spark.sparkContext
    if sent != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        # Executors fetch the file from the driver whenever they start, so it stays as long as the driver.
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/edupulse-library", "zip", package.parent, package.name))
        ship_library.sent = context.applicationId


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free_prefix(columns: list[str], start: str = "__") -> str:
    """``start``, with more underscores if a column begins with it."""
    while any(c.lower().startswith(start) for c in columns):
        start = "_" + start
    return start


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, …: what goes to a Python task may not have dots in its names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


# Bits of the table that ``among`` sends to every task, 4 MB at most however large the tables are.
AMONG_BITS = 1 << 25


def among(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose value the one column of ``wanted`` may hold: all that it holds and, by hash, few others.

    Goes before an exact join, so that wide rows without a partner are not moved.
    """
    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(AMONG_BITS))

    free = free_prefix(df.columns)
    at, bucket, bits = place(wanted.columns[0]), f"{free}bucket", f"{free}bits"
    held = wanted.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    rows = df.withColumn(bucket, F.bitmap_bucket_number(place(column)))
    bit = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(held), bucket).where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop(bucket, bits)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; a null is empty."""
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
