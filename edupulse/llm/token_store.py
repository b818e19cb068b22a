"""Token ids as ORC files.

A store is a folder of ORC files, one per range of doc_ids, rows in ascending doc_id order. Ids are
an integer column, so ORC run-length-encodes them; every stripe carries row indexes (minimum and
maximum of each ``ROW_INDEX`` rows) and a Bloom filter on doc_id. Readers split files at stripes
and skip stripes and row groups by these. ``manifest`` states the ids before each shard, so that a
reader finds any document's place in the whole without reading what lies before it.

Odd cases: a null text is empty and holds the end id alone; null doc_ids come first; rows with equal
doc_id are ordered by the hash of their text; repeated rows are stored as often as they occur; columns other than doc_id and
text are not read; an empty table gives an empty store.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edupulse.llm.staging import steps, text_or_empty
from edupulse.llm.tokens import BYTE_BPE, END_ID, STEP, encoder
from edupulse.operators.sizes import broadcast_if_small
from edupulse.session import ensure_checkpoint_dir

ROW_INDEX = 1_000
STRIPE_BYTES = 16 << 20
STORE = "shard int, doc_id long, start_in_shard long, n_tokens long, ids array<int>"
MANIFEST = "shard int, n_documents long, n_tokens long, start long"


def encode_sorted(documents: DataFrame, *, tokenizer: str = BYTE_BPE) -> DataFrame:
    """Rows of the store. Texts are dealt out by range and sorted before they are encoded, so that
    ids are never shuffled; a hot doc_id is spread by the hash of its text."""
    end = np.array([END_ID], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for batch in steps(batches, limit=STEP):
            ids = [np.frombuffer(found + end, "<i4") for found in encoder(tokenizer).encode(batch.column("text").to_pylist())]
            sizes = np.array([len(x) for x in ids], np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            offsets = pa.array(edges, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ids), shard), pa.int32()), batch.column("doc_id").cast(pa.int64()),
                pa.array(start + edges[:-1], pa.int64()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))],
                names=["shard", "doc_id", "start_in_shard", "n_tokens", "ids"])
            start += int(edges[-1])

    order = ["doc_id", "_tie"]
    return (documents.select("doc_id", text_or_empty().alias("text"), F.xxhash64("text").alias("_tie"))
            .repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").mapInArrow(encode, STORE))


def write_store(documents: DataFrame, path: str, *, tokenizer: str = BYTE_BPE) -> None:
    """Writes ``path/data`` and ``path/manifest``."""
    spark = documents.sparkSession
    (encode_sorted(documents, tokenizer=tokenizer).write
     .option("compression", "snappy").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROW_INDEX)
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
     .orc(f"{path}/data"))
    shards = (spark.read.schema(STORE).orc(f"{path}/data").groupBy("shard")
              .agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens")))
    # One row a file; blocks of shards keep the running sum out of a single task.
    block = F.floor(F.col("shard") / 1000).cast("int")
    shards = shards.withColumn("_block", block)
    blocks = shards.groupBy("_block").agg(F.sum("n_tokens").alias("_n"))
    blocks = blocks.withColumn("_first", F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).drop("_n")
    inside = F.sum("n_tokens").over(Window.partitionBy("_block").orderBy("shard")) - F.col("n_tokens")
    (shards.withColumn("_inside", inside).join(broadcast_if_small(blocks), "_block")
     .select("shard", "n_documents", "n_tokens", (F.col("_first") + F.col("_inside")).alias("start"))
     .write.orc(f"{path}/manifest"))


def read_store(spark: SparkSession, path: str, *, doc_ids: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The stored rows with ``start`` (ids of all documents before). ``doc_ids`` are pushed to the
    files, which skip stripes and row groups by their indexes and Bloom filters."""
    data = spark.read.schema(STORE).orc(f"{path}/data")
    if doc_ids is not None:
        data = data.where(F.col("doc_id").isin(list(doc_ids)))
    manifest = broadcast_if_small(spark.read.schema(MANIFEST).orc(f"{path}/manifest").select("shard", F.col("start").alias("_first")))
    rows = data.join(manifest, "shard").withColumn("start", F.col("_first") + F.col("start_in_shard"))
    return rows.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def checksums(rows: DataFrame) -> DataFrame:
    """ids_crc32 of each row's ids as little-endian unsigned 32-bit integers, instead of the ids."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, edges = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(edges, edges[1:])]  # noqa: B905
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def temporary_store(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
