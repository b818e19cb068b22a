"""Hard negatives by exact inner products from subset-sum tables (the method of the Four Russians).

Vectors are quantised to integers, floor(256 * x), and stored as bit planes of their two's complement, eight dimensions
a byte. For each group of eight dimensions an anchor has a table of the sums of all 256 subsets of its components; a
candidate's byte of a plane is an index into it. Looked-up sums are added over the groups, and shifted and added over the
planes (the top plane, the sign, counts negative): the full exact score, without a multiplication.

Anchors (a hundredth of the rows) meet all candidates in blocks: (anchor group, candidate block) is the key of a
cogroup, so a task holds one group and one block. First only equal labels are scored, and a block keeps an anchor's best
rows; the best of these are the positives. Then rows of other labels are scored, and a block keeps the best within each
positive's range of scores. Both cuts are exact, as the best of all blocks are among the best of each.

Odd cases: rows with a null label or vector, or with a null or non-finite component, take no part. A row with a null vec_id is
no anchor, comes after all others in ties, and is reported as null. Missing dimensions of shorter vectors count as zero.
Equal rows are rows of their own among candidates; equal anchors are one anchor, whose copies are other rows of its label. A
score beyond 64 bits counts as the nearest 64-bit integer. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edupulse.llm.staging import stage

SCALE = 256
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
# A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
# Candidates, and anchors, that a task takes at a time; anchors whose tables are held at a time.
BLOCK_ROWS = 4_096
_TABLES = 64
_LONG = 2**62
_MOST = 2**63 - 1

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def training_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector): rows that take part, some with the next label."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    return embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad).select("vec_id", moved.alias("label"), x.alias("vector"))


def quantise(vectors: np.ndarray) -> np.ndarray:
    """Integer components; Python integers where 64 bits would not hold them."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * SCALE)
    if (np.abs(scaled) < _LONG).all():
        return scaled.astype(np.int64)
    # From 2**52 on a double is whole.
    whole = [int(x) * SCALE if abs(x) >= 2**52 else math.floor(x * SCALE) for x in vectors.ravel().tolist()]
    return np.array(whole, object).reshape(vectors.shape)


def pack(components: np.ndarray, planes: int) -> np.ndarray:
    """Rows of integers as bit planes, the sign first: (rows, planes, bytes)."""
    out = np.zeros((len(components), planes, -(-components.shape[1] // 8)), np.uint8)
    for p in range(planes):
        out[:, p] = np.packbits(((components >> (planes - 1 - p)) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def unpack(bits: bytes, planes: int) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(planes, -1), axis=1, bitorder="little")
    total = -held[0].astype(np.int64 if planes < 60 else object)
    for plane in held[1:]:
        total = 2 * total + plane
    return total


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups of eight dimensions, 256, anchors): sums of every subset of the group's components."""
    n, dims = anchors.shape
    out = np.zeros((dims // 8, 256, n), anchors.dtype)
    for g in range(dims // 8):
        for i in range(8):
            out[g, 1 << i: 2 << i] = out[g, : 1 << i] + anchors[:, 8 * g + i]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors) of packed candidates with the tables' anchors."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    looked = np.empty_like(total)
    for p in range(planes.shape[1]):
        total += total
        for g in range(min(len(tables), planes.shape[2])):
            np.take(tables[g], planes[:, p, g], axis=0, out=looked, mode="clip")
            if p:
                total += looked
            else:
                total -= looked
    return total


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their vectors as planes, as many as the row's largest component needs."""
    for b in batches:
        column = b.column(2)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        lengths = np.asarray(pa.compute.list_value_length(column), np.int64)
        begin = np.cumsum(lengths) - lengths
        planes, bits = np.ones(b.num_rows, np.int32), [b""] * b.num_rows
        for length in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == length)
            components = quantise(flat[begin[at][:, None] + np.arange(length)])
            planes[at] = [int(x).bit_length() + 1 for x in np.abs(components).max(axis=1)]
            for p in np.unique(planes[at]):
                of = np.flatnonzero(planes[at] == p)
                for i, row in zip(at[of], pack(components[of], int(p)), strict=True):
                    bits[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(planes), pa.array(bits, pa.binary())], ["vec_id", "label", "planes", "bits"])


class _Candidates:
    """A block's rows by (label, id), and their planes: one array for the rows of as many bytes a plane."""

    def __init__(self, block: pa.Table):
        ids = block.column("vec_id")
        named, ids, labels = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(), block.column("label").to_numpy()
        order = np.lexsort((ids, ~named, labels))
        self.ids, self.labels, self.named = ids[order], labels[order], named[order]
        self.planes, raw = block.column("planes").to_numpy()[order], block.column("bits").to_pylist()
        self.bits = [raw[i] for i in order]
        sizes = np.array([len(x) for x in self.bits], np.int64) // self.planes
        # Rows of fewer planes are extended by their sign; a row that needs many does not extend all others.
        kinds = np.stack([sizes, np.where(self.planes <= 24, 0, self.planes)], axis=1)
        self.parts = []
        for kind in np.unique(kinds, axis=0):
            at = np.flatnonzero((kinds == kind).all(axis=1))
            most = self.planes[at].max()
            held = np.zeros((len(at), most, kind[0]), np.uint8)
            for p in np.unique(self.planes[at]):
                of = np.flatnonzero(self.planes[at] == p)
                own = np.frombuffer(b"".join([self.bits[i] for i in at[of]]), np.uint8).reshape(len(of), p, kind[0])
                held[of, most - p:] = own
                held[of, : most - p] = own[:, :1]
            self.parts.append((at, held))

    def id(self, i: int) -> int | None:
        return int(self.ids[i]) if self.named[i] else None

    def scores(self, anchors: list[np.ndarray], first: int, last: int) -> np.ndarray:
        """Scores of the rows first..last - 1 with each anchor."""
        table = np.zeros((len(anchors), max(map(len, anchors))), object if any(a.dtype == object for a in anchors) else np.int64)
        for i, a in enumerate(anchors):
            table[i, : len(a)] = a
        largest = max((abs(int(x)) for x in (table.max(), table.min())), default=0) if table.size else 0
        # No sum on the way is larger than all components of the largest size.
        most = max([table.shape[1] * largest << held.shape[1] for _, held in self.parts], default=0)
        kind = np.int32 if most < 2**30 else np.int64 if most < _LONG else object
        tables, out = subset_sums(table.astype(kind)), np.zeros((last - first, len(anchors)), np.int64)
        for at, held in self.parts:
            a, b = np.searchsorted(at, (first, last))
            if b > a:
                found = scores(tables, held[a:b])
                out[at[a:b] - first] = np.clip(found, -_MOST, _MOST) if kind is object else found
        return out


def _by_tables(anchors: pa.Table) -> Iterator[tuple[slice, list[np.ndarray]]]:
    planes, bits = anchors.column("planes").to_pylist(), anchors.column("bits").to_pylist()
    for i in range(0, len(bits), _TABLES):
        yield slice(i, min(i + _TABLES, len(bits))), [unpack(b, p) for b, p in zip(bits[i: i + _TABLES], planes[i: i + _TABLES], strict=True)]


_ALIKE = pa.schema([("anchor", pa.int64()), ("own", pa.bool_()), ("candidate", pa.int64()), ("score", pa.int64())])
_INSIDE = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("score", pa.int64())])


def _best_alike(anchors: pa.Table, block: pa.Table) -> pa.Table:
    """An anchor's best rows of its own label, one more than the positives: its own row may be among them."""
    found = []
    if anchors.num_rows and block.num_rows:
        candidates = _Candidates(block)
        anchors = anchors.sort_by("label")
        labels = anchors.column("label").to_numpy()
        names, ids, bits = (anchors.column(c).to_pylist() for c in ("anchor", "vec_id", "bits"))
        for here, vectors in _by_tables(anchors):
            for label in np.unique(labels[here]):
                first, last = np.searchsorted(candidates.labels, label, "left"), np.searchsorted(candidates.labels, label, "right")
                of = here.start + np.flatnonzero(labels[here] == label)
                if first == last:
                    continue
                table = candidates.scores([vectors[i - here.start] for i in of], first, last)
                for i, column in zip(of, table.T, strict=True):
                    for at in np.argsort(-column, kind="stable")[: POSITIVES + 1]:
                        row = first + at
                        found.append((names[i], candidates.id(row) == ids[i] and candidates.bits[row] == bits[i], candidates.id(row), int(column[at])))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _ALIKE, strict=True)], schema=_ALIKE) if found else _ALIKE.empty_table()


def _best_inside(anchors: pa.Table, block: pa.Table) -> pa.Table:
    """For each positive of an anchor, the best rows of other labels in its range of scores."""
    found = []
    if anchors.num_rows and block.num_rows:
        candidates = _Candidates(block)
        by_id = np.lexsort((candidates.ids, ~candidates.named))
        labels, names, wanted = (anchors.column(c).to_pylist() for c in ("label", "anchor", "scores"))
        for here, vectors in _by_tables(anchors):
            table = candidates.scores(vectors, 0, len(by_id))
            for i in range(here.start, here.stop):
                other = by_id[candidates.labels[by_id] != labels[i]]
                column = table[other, i - here.start]
                # LOWEST * positive <= 100 * negative <= HIGHEST * positive
                ranges = [(-(-LOWEST * s // 100), HIGHEST * s // 100) for s in wanted[i]]
                near = np.flatnonzero((column >= min(r[0] for r in ranges)) & (column <= max(r[1] for r in ranges)))
                order = near[np.argsort(-column[near], kind="stable")]
                falling = -column[order]
                for place, (low, high) in enumerate(ranges):
                    first, last = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                    for at in order[first: min(last, first + NEGATIVES)]:
                        found.append((names[i], place, candidates.id(other[at]), int(column[at])))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _INSIDE, strict=True)], schema=_INSIDE) if found else _INSIDE.empty_table()


def mine(embeddings: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive."""
    spark = embeddings.sparkSession
    packed = training_rows(embeddings).mapInArrow(_packed, "vec_id long, label long, planes int, bits binary")
    packed = stage(packed.withColumn("row", F.monotonically_increasing_id()))
    anchors = packed.drop("row").filter(F.col("vec_id") % ANCHOR_EVERY == 0).distinct()
    anchors = stage(anchors.withColumn("anchor", F.monotonically_increasing_id()))
    n_rows, n_anchors = packed.count(), anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], _RESULT)
    # Small inputs are cut finer, so that all cores have work.
    block_rows = block_rows or min(BLOCK_ROWS, max(256, n_rows // (2 * spark.sparkContext.defaultParallelism)))
    n_blocks, n_groups = -(-n_rows // block_rows), -(-n_anchors // BLOCK_ROWS)

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Dealt by number, not by content: blocks are even whatever the labels, ids and vectors.
    blocks = packed.withColumn("block", F.pmod(F.hash("row"), F.lit(n_blocks))).drop("row").withColumn("group", each(n_groups))
    grouped = anchors.withColumn("group", F.pmod(F.hash("anchor"), F.lit(n_groups)))

    def meet(side: DataFrame, function, schema: pa.Schema) -> DataFrame:
        left = side.withColumn("block", each(n_blocks)).groupBy("group", "block")
        types = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}
        return left.cogroup(blocks.groupBy("group", "block")).applyInArrow(function, ", ".join(f"{f.name} {types[f.type]}" for f in schema))

    def first(n: int, by: tuple[str, ...], candidate: str, df: DataFrame) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last(candidate))
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    alike = first(POSITIVES + 1, ("anchor",), "candidate", meet(grouped, _best_alike, _ALIKE))
    # The anchor's own row goes, once; what remains are the best other rows, whether it was among them or not.
    ordered = F.sort_array(F.collect_list(F.struct("own", "rank", "candidate", "score")), asc=False)
    kept = alike.groupBy("anchor").agg(ordered.alias("rows")).select(
        "anchor", F.sort_array(F.expr("transform(if(rows[0].own, slice(rows, 2, size(rows)), rows), r -> struct(r.rank, r.candidate, r.score))")).alias("rows"))
    kept = stage(kept.select("anchor", F.slice("rows", 1, POSITIVES).alias("rows")).filter(F.size("rows") > 0))
    inside = meet(grouped.join(kept.select("anchor", F.col("rows.score").alias("scores")), "anchor"), _best_inside, _INSIDE)
    negatives = first(NEGATIVES, ("anchor", "place"), "negative_id", inside)
    positives = kept.select("anchor", F.posexplode("rows").alias("place", "positive")).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return negatives.join(positives, ["anchor", "place"]).select(
        "anchor_id", F.col("positive.candidate").alias("positive_id"), "rank", "negative_id", F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
