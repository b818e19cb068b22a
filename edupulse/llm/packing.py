"""Best-fit packing by exact complements.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (one
number per length, so at most ``capacity`` numbers) is planned on: for each long length the gap it
leaves is looked up among the single lengths, the sums of two and the sums of three that are still
available, and a combination that fills the gap exactly is used as often as its counts allow. What
has no exact complement is packed best-fit, largest piece first, trying an exact complement of the
gap again after each placement. The plan is a list of patterns with multiplicities; pieces take
their places in it by their rank among the pieces of equal length, which Spark computes.

Inputs and odd cases: a null text is empty and is the end id alone; repeated rows are packed as
often as they occur; a null doc_id is kept; columns other than doc_id and text are not read; an
empty table gives no rows. Ties between pieces of equal length are broken by doc_id, piece and
checksum; rows equal in all of them are interchangeable.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edupulse.llm.staging import stage, steps, text_or_empty
from edupulse.llm.tokens import END_ID, WORD_BPE, STEP, encoder

CAPACITY = 2048

# Rows of one length that one task ranks; lengths with more are salted.
RANK_ROWS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, *, tokenizer: str = WORD_BPE, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: consecutive runs of ``capacity`` tokens, the last maybe shorter."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in steps(batches, limit=STEP):
            ids = encode(batch.column("text").to_pylist())
            rows, out, starts, lengths, sums, held = [], [], [], [], [], []
            for i, found in enumerate(ids):
                found += end
                for piece, at in enumerate(range(0, len(found) // 4, capacity)):
                    part = found[4 * at: 4 * (at + capacity)]
                    rows.append(i)
                    out.append(piece)
                    starts.append(at)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        held.append(np.frombuffer(part, "<u4"))
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())).cast(pa.int64()), pa.array(out, pa.int32()),
                       pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, schema)


def _exact(counts: np.ndarray, gap: int) -> dict[int, int] | None:
    """Up to three available lengths that sum to ``gap``, larger ones first."""
    def available(parts: tuple[int, ...]) -> dict[int, int] | None:
        need: dict[int, int] = {}
        for p in parts:
            need[p] = need.get(p, 0) + 1
        return need if all(counts[p] >= n for p, n in need.items()) else None

    def pair(total: int, most: int) -> tuple[int, int] | None:
        large = np.arange(min(total - 1, most), (total + 1) // 2 - 1, -1)
        if not len(large):
            return None
        usable = np.flatnonzero((counts[large] > 0) & (counts[total - large] > 0) & ((large * 2 != total) | (counts[large] > 1)))
        return (int(large[usable[0]]), int(total - large[usable[0]])) if len(usable) else None

    if counts[gap] > 0:
        return {gap: 1}
    if found := pair(gap, gap - 1):
        return available(found)
    for first in np.flatnonzero(counts[: gap - 1])[::-1]:
        if 3 * first < gap:
            break
        counts[first] -= 1
        found = pair(gap - int(first), int(first))
        counts[first] += 1
        if found:
            return available((int(first), *found))
    return None


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, copies), …]), …]: every piece of the histogram in one pattern's sequence.

    A pattern ends when one of its lengths runs short of its copies, so there are at most
    sum(capacity / length) patterns, however many documents there are.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan: list[tuple[int, list[tuple[int, int]]]] = []

    def use(need: dict[int, int]) -> None:
        times = min(int(counts[p]) // n for p, n in need.items())
        for p, n in need.items():
            counts[p] -= n * times
        plan.append((times, sorted(need.items(), reverse=True)))

    # Exact complements of the lengths of over half a sequence, longest first.
    for length in range(capacity, capacity // 2, -1):
        while counts[length]:
            rest = {} if length == capacity else _exact(counts, capacity - length)
            if rest is None:
                break
            use({length: 1, **rest})
    # The rest, best fit.
    for length in range(capacity, 0, -1):
        while counts[length]:
            need, gap = {length: 1}, capacity - length
            counts[length] -= 1
            taken = [length]
            while gap:
                rest = _exact(counts, gap)
                if rest is None:
                    fits = np.flatnonzero(counts[1: gap + 1])
                    if not len(fits):
                        break
                    rest = {int(fits[-1]) + 1: 1}
                for p, n in rest.items():
                    need[p] = need.get(p, 0) + n
                    counts[p] -= n
                    taken += [p] * n
                    gap -= p * n
            for p in taken:
                counts[p] += 1
            use(need)
    return plan


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), sorted: where the ranks of a length go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, parts in plan:
        offset = 0
        for length, copies in parts:
            rows.append((length, used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(cut: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of ``PIECES``, and others that are kept).

    ``cut`` is read three times: give it staged.
    """
    spark = cut.sparkSession
    lengths = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    salts = 1 + max(lengths.values(), default=0) // RANK_ROWS
    # 2^40 ranks of a length at most, so that (length, rank) fits a long.
    places = spark.sparkContext.broadcast(_places(plan_patterns(lengths, capacity)))

    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = (salted.groupBy("length", "_salt").count()
              .withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count"))
              .drop("count"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("_rank", F.row_number().over(within))
              .join(before, ["length", "_salt"])
              .withColumn("_rank", F.col("_rank") - 1 + F.col("_before")))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = places.value
        segment = np.searchsorted((at[:, 0] << 40) + at[:, 1], (length.to_numpy() << 40) + rank.to_numpy(), "right") - 1
        of, first, sequence, copies, offset = at[segment].T
        turn = rank.to_numpy() - first
        return pd.DataFrame({"sequence_id": sequence + turn // copies, "offset": offset + turn % copies * of})

    columns = [F.col(c) for c in cut.columns]
    return (ranked.withColumn("_place", placed("length", "_rank"))
            .select(*columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset")))


def pack(documents: DataFrame, *, tokenizer: str = WORD_BPE, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return place(stage(pieces(documents, tokenizer=tokenizer, capacity=capacity, with_ids=with_ids)), capacity=capacity)
