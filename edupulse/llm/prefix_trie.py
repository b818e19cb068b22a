"""Prefix trie of conversations from sorted longest common prefixes.

Turns become 128-bit digests of (role, text); a conversation is its sequence of digests. Equal
sequences are counted first, so that copies never meet in one task. The distinct sequences are range
partitioned and sorted; a partition is a *block*. In a block every distinct prefix is a candidate, and a
sparse table of range minima over the LCPs of neighbouring sequences lets each candidate binary-search the
left and right end of its members independently of all others. Counts, leaves and saved tokens are then
differences of running sums over the interval.

A prefix that two neighbouring blocks share is left *open*: each block reports its part, a second sparse table
(over one number a block) names the block where the prefix starts, and the parts are summed under that name.
The driver holds three numbers a block (``BLOCK_ROWS`` sequences), never sequences or members.

``ends_sha256`` hashes decimal ids in ascending order: sorted ids are joined to runs of ``RUN_IDS``, and the runs of
one sequence stream through one hash.

Odd cases: a null role or text is empty; turns of a conversation are ordered by (turn, null first; digest), so
equal turns have a fixed order and repeated rows stay turns; rows without conv_id take no part; an empty table has no
nodes, not even a root; other columns are not read. A conversation is one record, as a text is elsewhere: its digests
(16 bytes a turn) are held in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.llm.staging import stage

BLOCK_ROWS = 20_000
RUN_IDS = 4_096
# The contract's rebuilding: conversations of one hundred share their first turns.
SHARED, HEAD_TURNS = 100, 6

NOTHING = hashlib.sha256(b"").hexdigest()
_FAR = np.iinfo(np.int64).max


class RangeMinimum:
    """Sparse table: level k holds the minima of all runs of 2**k values."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values, np.int64)]
        while 2 * (half := 1 << (len(self.levels) - 1)) <= len(values):
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def minimum(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least value of each first..last (both included)."""
        out = np.empty(len(first), np.int64)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return out

    def right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Largest place such that the values after start, up to it, are all at least bound."""
        at, n = start.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.flatnonzero(at + (1 << k) < n)
            go = inside[self.levels[k][at[inside] + 1] >= bound[inside]]
            at[go] += 1 << k
        return at

    def left(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Least place such that the values after it, up to start, are all at least bound."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.flatnonzero(at >= 1 << k)
            go = inside[self.levels[k][at[inside] - (1 << k) + 1] >= bound[inside]]
            at[go] -= 1 << k
        return at


def neighbour_lcps(turns: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before it; -1 for the first."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.int64)
    out[:1] = -1
    alike, depth = np.arange(1, len(lengths)), 0
    while len(alike):
        alike = alike[np.minimum(lengths[alike - 1], lengths[alike]) > depth]
        alike = alike[(turns[offsets[alike - 1] + depth] == turns[offsets[alike] + depth]).all(axis=1)]
        depth += 1
        out[alike] = depth
    return out


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes): hexadecimal digests and code points of a conversation's turns in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn"), F.md5(F.concat_ws(":", F.char_length(role), role, text)).alias("key"), F.char_length(text).alias("size"))
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", turn.alias("turn"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.size").alias("sizes"))


def rebuild(conversations: DataFrame) -> DataFrame:
    """Sequences whose first turns are those of the first conversation of their hundred."""
    own = sequences(conversations)
    base = own.filter(F.col("conv_id") % SHARED == 0).select(
        F.col("conv_id").alias("base"), *(F.slice(c, 1, HEAD_TURNS - 1).alias(f"base_{c}") for c in ("keys", "sizes")))
    taken = (F.crc32(F.col("conv_id").cast("string")) % HEAD_TURNS).cast("int")
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % SHARED, "taken": taken})

    def joined(column: str):
        none = F.array().cast(own.schema[column].dataType)
        # A slice of no turns is empty, of more turns than there are all of them.
        return F.concat(F.coalesce(F.expr(f"slice(base_{column}, 1, taken)"), none), F.expr(f"slice({column}, taken + 1, size({column}))")).alias(column)

    return own.join(base, "base", "left").select("conv_id", joined("keys"), joined("sizes"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sequence, conv_id) rows as runs of joined ids."""
    held: list[str] = []
    key, first, out = None, 0, ([], [], [])

    def close():
        if held:
            for column, value in zip(out, (key, first, ",".join(held)), strict=True):
                column.append(value)
            held.clear()

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["sequence", "first", "ids"])
        for column in out:
            column.clear()
        return made

    for b in batches:
        for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key or len(held) == RUN_IDS:
                close()
                key, first = k, i
            held.append(str(i))
        if len(out[0]) >= 1_000:
            yield batch()
    close()
    yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs as one hash a sequence; a sequence's runs pass one after the other."""
    key, state = None, None
    for b in batches:
        keys, ends = [], []
        for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if state:
                keys.append(key)
                ends.append(state.hexdigest())
            key, state = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["sequence", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["sequence", "ends"])


def distinct_sequences(rebuilt: DataFrame, partitions: int) -> DataFrame:
    """One row a distinct sequence: its key and sizes, its conversations' number, least id and hash of all ids."""
    members = rebuilt.select("sequence", "conv_id")
    counted = members.groupBy("sequence").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    runs = members.repartitionByRange(partitions, "sequence", "conv_id").sortWithinPartitions("sequence", "conv_id").mapInArrow(
        _runs, "sequence binary, first long, ids string")
    ends = runs.repartition(partitions, "sequence").sortWithinPartitions("sequence", "first").mapInArrow(_hashed, "sequence binary, ends string")
    # The conversation with the least id stands for its sequence; a conv_id has one row.
    shown = rebuilt.select("conv_id", "key", "sizes")
    return counted.join(ends, "sequence").join(shown, "conv_id").select("key", "sizes", "n", "conv_id", "ends")


_BLOCK = "part int, lengths array<int>, turns binary, sizes array<int>, n array<long>, conv_id array<long>, ends array<string>, inner_lcp long, first binary, last binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition as one row."""
    keys, sizes, counts, ids, ends = [], [], [], [], []
    for b in batches:
        for held, column in zip((keys, sizes, counts, ids, ends), b.columns, strict=True):
            held.append(column)
    if not sum(len(k) for k in keys):
        return
    keys = pa.concat_arrays(keys)
    lengths = np.asarray(pa.compute.binary_length(keys)) // 16
    first, last = keys[0].as_py(), keys[-1].as_py()
    turns = b"".join(keys.to_pylist())
    lcp = neighbour_lcps(np.frombuffer(turns, "<u8").reshape(-1, 2), np.concatenate([[0], np.cumsum(lengths)]))
    row = {
        "part": [TaskContext.get().partitionId()], "lengths": [lengths], "turns": [turns], "sizes": [pa.concat_arrays(sizes).flatten().to_numpy(zero_copy_only=False)],
        "n": [pa.concat_arrays(counts).to_numpy()], "conv_id": [pa.concat_arrays(ids).to_numpy()], "ends": [pa.concat_arrays(ends).to_pylist()],
        "inner_lcp": [int(lcp[1:].min()) if len(lcp) > 1 else _FAR], "first": [first], "last": [last]}
    types = [pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], list(row))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that a block's first sequence shares with the last one of the block before."""
    for b in batches:
        shared = []
        for before, first in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if before is None:
                shared.append(-1)
                continue
            both = np.frombuffer(before + first, "<u8").reshape(-1, 2)
            shared.append(int(neighbour_lcps(both, np.array([0, len(before) // 16, len(both)]))[1]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int64())], ["number", "inner_lcp", "shared"])


_NODE = ("block long, row long, depth long, open boolean, start long, parent_start long, parent_row long, conv_id long, parent_conv_id long, "
         "n_convs long, n_children long, n_leaves long, saved long, size long, ends string")
_LONGS = ["block", "row", "depth", "start", "parent_start", "parent_row", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "size"]


def block_nodes(block: int, lengths, turns, sizes, counts, ids, ends, shared: np.ndarray, across: RangeMinimum) -> pa.RecordBatch:
    """All prefixes of a block's sequences. ``shared``: turns in common with the block before, by block, and -1 after the last."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    lcp = neighbour_lcps(np.frombuffer(turns, "<u8").reshape(-1, 2), offsets)
    table, before, after = RangeMinimum(lcp), shared[block], shared[block + 1]
    # Nodes by (row, depth): a row adds the prefixes that it doesn't share with the row before, so a subtree is a run of nodes.
    made = lengths - lcp
    begin = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(lengths)), made)
    depth = np.arange(begin[-1]) - begin[row] + lcp[row] + 1
    last = table.right(row, depth)
    end = begin[last + 1]
    chained = depth - 1 > lcp[row]
    parent = np.arange(begin[-1]) - 1
    far = np.flatnonzero(~chained & (depth > 0))
    top = table.left(row[far], depth[far] - 1)
    parent[far] = begin[top] + depth[far] - 1 - (lcp[top] + 1)
    left, right = (row == 0) & (depth <= before), (last == len(lengths) - 1) & (depth <= after)
    is_open = left | right

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[end] - total[:-1]

    members = np.concatenate([[0], np.cumsum(counts)])
    n = members[last + 1] - members[row]
    size = np.where(depth > 0, np.append(sizes, 0)[offsets[row] + np.maximum(depth, 1) - 1], 0).astype(np.int64)
    conv = RangeMinimum(ids).minimum(row, last)
    leaf = np.zeros(begin[-1], np.int64)
    ending = begin[1:] - 1
    leaf[ending] = np.append(lcp[1:], after) < lengths
    own_ends = np.full(begin[-1], None, object)
    own_ends[ending] = ends
    start = np.full(begin[-1], block)
    at = np.flatnonzero(left)
    start[at] = across.left(np.full(len(at), block - 1), depth[at])
    inner = parent >= 0
    begins = inner & ~left
    children = np.bincount(parent[begins], minlength=begin[-1])
    up = np.where(inner, parent, 0)
    to_open = inner & is_open[up]

    def column(values, present=None):
        return pa.array(values.astype(np.int64), pa.int64(), mask=None if present is None else ~present)

    return pa.RecordBatch.from_arrays([
        column(np.full(begin[-1], block)), column(row), column(depth), pa.array(is_open), column(start), column(start[up], begins & to_open), column(row[up], to_open), column(conv),
        column(conv[up], inner & ~to_open), column(n), column(children), column(below(leaf)), column(below(np.where(is_open, 0, (n - 1) * size))), column(size),
        pa.array(own_ends, pa.string())], [c.split()[0] for c in _NODE.split(", ")])


def _nodes_of(numbers: dict[int, int], shared: np.ndarray, inner: np.ndarray):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = RangeMinimum(np.minimum(shared[:-1], inner))
        for b in batches:
            for i in range(b.num_rows):
                part, turns = b.column("part")[i].as_py(), b.column("turns")[i].as_py()
                lengths, sizes, counts, ids = (np.asarray(b.column(c)[i].values, np.int64) for c in ("lengths", "sizes", "n", "conv_id"))
                yield block_nodes(numbers[part], lengths, turns, sizes, counts, ids, b.column("ends")[i].as_py(), shared, across)

    return nodes


def trie(rebuilt: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The nodes of the trie over (conv_id, keys, sizes); a conv_id has one row."""
    spark = rebuilt.sparkSession
    block_rows = block_rows or BLOCK_ROWS
    key = F.unhex(F.array_join("keys", ""))
    rebuilt = stage(rebuilt.select("conv_id", key.alias("key"), F.unhex(F.md5(key)).alias("sequence"), "sizes"))
    partitions = max(1, -(-rebuilt.count() // block_rows))
    distinct = distinct_sequences(rebuilt, max(partitions, spark.sparkContext.defaultParallelism))
    blocks = stage(distinct.repartitionByRange(partitions, "key").sortWithinPartitions("key").mapInArrow(_cut, _BLOCK))

    parts = sorted(r["part"] for r in blocks.select("part").collect())
    numbers = {p: i for i, p in enumerate(parts)}
    order = spark.createDataFrame([(p, numbers[p], parts[i - 1] if i else None) for i, p in enumerate(parts)], "part int, number long, before int")
    edges = blocks.select("part", "inner_lcp", "first").join(order, "part").join(
        blocks.select(F.col("part").alias("before"), "last"), "before", "left").select("number", "inner_lcp", "last", "first").mapInArrow(
        _shared, "number long, inner_lcp long, shared long")
    edges = sorted(edges.collect())
    shared = np.array([e["shared"] for e in edges] + [-1], np.int64)
    inner = np.array([e["inner_lcp"] for e in edges], np.int64)
    nodes = blocks.mapInArrow(_nodes_of(numbers, shared, inner), _NODE)
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")]
    if len(parts) < 2:
        return nodes.select(*result)

    nodes = stage(nodes)
    pieces = nodes.filter("open")
    merged = pieces.groupBy("start", "depth").agg(
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.min("conv_id").alias("conv_id"), F.max("block").alias("last"),
        F.max("size").alias("size"), F.max("ends").alias("ends"), F.max("parent_start").alias("parent_start"))
    merged = merged.withColumn("own", (F.col("n_convs") - 1) * F.col("size"))
    # An open node's subtree holds the open nodes below it that start in its first block, and all that start in its middle blocks.
    by_block = dict(merged.groupBy("start").agg(F.sum("own")).collect())
    total = np.concatenate([[0], np.cumsum([by_block.get(i, 0) for i in range(len(parts))])])
    sums = spark.createDataFrame([(i, int(total[i]), int(total[i + 1])) for i in range(len(parts))], "number long, up_to long, through long")
    from pyspark.sql import Window

    down = Window.partitionBy("start").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.withColumn("chain", F.sum("own").over(down)).join(sums.select(F.col("number").alias("start"), "through"), "start").join(
        sums.select(F.col("number").alias("last"), "up_to"), "last").withColumn("saved", F.col("saved") + F.col("chain") + F.col("up_to") - F.col("through"))
    merged = stage(merged)
    above = merged.select(F.col("start").alias("parent_start"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    whole = merged.join(above, ["parent_start", "depth"], "left").select(*result)
    closed = nodes.filter("NOT open")
    # Parents that reach into other blocks are found by block, so that no prefix is a hot key.
    named = pieces.select("block", F.col("row").alias("parent_row"), "depth", "start").join(merged.select("start", "depth", F.col("conv_id").alias("found")), ["start", "depth"])
    hanging = closed.filter("parent_row IS NOT NULL").drop("parent_conv_id", "start").join(
        named.select("block", "parent_row", (F.col("depth") + 1).alias("depth"), F.col("found").alias("parent_conv_id")), ["block", "parent_row", "depth"])
    return closed.filter("parent_row IS NULL").select(*result).unionByName(hanging.select(*result)).unionByName(whole)


def report(conversations: DataFrame) -> DataFrame:
    return trie(rebuild(conversations))
