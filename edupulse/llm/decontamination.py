"""Benchmark decontamination with suffix arrays of the training text.

Each task builds the suffix array of its shard of the training text, as word numbers, and
binary-searches every window of every benchmark item in it: all suffixes that start with a window
lie in one range of the array. Occurrences on one diagonal join to the longest verbatim matches.
A suffix can only start with a window if its next words are all benchmark words, so words that no
item uses end a run and runs shorter than the shortest window are left out of the array, exactly.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
Benchmarks go to the tasks in blocks of at most ``BLOCK_BYTES`` of text; more blocks are taken one
after the other over all documents. Nothing is shuffled.

Odd cases: a null or wordless text has no words and is never hit; a null or wordless item has no
window; items with equal item_id count as one; a null item_id is never reported by name but its
windows hit; repeated rows are judged alike; an empty benchmark hits nothing; extra columns
of documents are carried along.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edupulse.llm.staging import as_bytes, free_prefix, numbered, quoted, stage, steps, text_or_empty

WINDOW = 10
BLOCK_BYTES = 16 << 20

# A-Z to a-z; every byte that is not a word's to a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_SPAN = "struct<start:int,end:int>"
_MATCH = "struct<item_id:string,start:int,item_start:int,n_words:int>"
_FOUND = {"n_words": "long", "spans": f"array<{_SPAN}>", "items": "array<string>", "matches": f"array<{_MATCH}>"}


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Windows:
    """The distinct windows of a block of items, as word numbers (0 pads)."""

    number: dict[bytes, int]
    table: np.ndarray
    sizes: np.ndarray
    uses: list[list[tuple[str | None, int]]]
    longest: int

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes]], window: int) -> Windows:
        number: dict[bytes, int] = {}
        uses: dict[tuple[int, ...], list[tuple[str | None, int]]] = defaultdict(list)
        longest = 0
        for item_id, text in items:
            coded = [number.setdefault(w, len(number) + 1) for w in words(text)]
            size = min(window, len(coded))
            longest = max(longest, len(coded))
            for at in range(len(coded) - size + 1 if coded else 0):
                uses[tuple(coded[at: at + size])].append((item_id, at))
        table = np.zeros((len(uses), window), np.int64)
        sizes = np.array([len(w) for w in uses], np.int64)
        for i, w in enumerate(uses):
            table[i, : len(w)] = w
        return cls(number, table, sizes, list(uses.values()), longest)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of what starts there, compared over ``depth`` numbers at
    least, by prefix doubling. Past the end counts as 0."""
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while k < depth and len(text):
        following = np.zeros_like(rank)
        following[:-k] = rank[k:] + 1
        distinct, rank = np.unique(rank * (rank.max() + 2) + following, return_inverse=True)
        k *= 2
        if len(distinct) == len(text):
            break
    return np.argsort(rank, kind="stable")


def _ranges(text: np.ndarray, order: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of suffixes that start with it, all windows searched in step."""
    width = windows.table.shape[1]
    padded = np.concatenate([text, np.zeros(width, np.int64)])
    inside = np.arange(width) < windows.sizes[:, None]

    def bound(right: bool) -> np.ndarray:
        low, high = np.zeros(len(windows.sizes), np.int64), np.full(len(windows.sizes), len(order), np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            differs = np.where(inside[open_], padded[order[middle][:, None] + np.arange(width)] - windows.table[open_], 0)
            first = differs[np.arange(len(open_)), (differs != 0).argmax(1)]
            below = (first <= 0) if right else (first < 0)
            low[open_] = np.where(below, middle + 1, low[open_])
            high[open_] = np.where(below, high[open_], middle)
        return low

    return bound(False), bound(True)


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _longest(seen: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, item start, words) of the maximal runs of windows (start, item start, size) of one item."""
    out: list[tuple[int, int, int]] = []
    for at, own, size in sorted(seen, key=lambda x: (x[0] - x[1], x[0])):
        if out and out[-1][0] - out[-1][1] == at - own and at <= out[-1][0] + out[-1][2] - size + 1:
            out[-1] = (out[-1][0], out[-1][1], at + size - out[-1][0])
        else:
            out.append((at, own, size))
    return out


def search(texts: list[bytes], windows: Windows) -> list[tuple[int, list[tuple[int, int]], set[str], list[tuple[str, int, int, int]]]]:
    """Per text: its words, hit spans, item ids, and longest matches (item, start, item start, words)."""
    number, coded, counts = windows.number.get, [], []
    for text in texts:
        split = words(text)
        counts.append(len(split))
        coded += [number(w, 0) for w in split]
        coded.append(0)
    whole = np.array(coded, np.int64)
    edges = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
    found: list = [(n, [], set(), []) for n in counts]
    if not len(windows.sizes):
        return found

    # Runs of benchmark words, of the shortest window's length at least, with one 0 after each.
    change = np.flatnonzero(np.diff(np.concatenate([[0], (whole > 0).astype(np.int8), [0]])))
    first, last = change[::2], change[1::2]
    long_enough = last - first >= windows.sizes.min()
    first, last = first[long_enough], last[long_enough]
    if not len(first):
        return found
    sizes = last - first + 1  # the number after a run is a 0
    place = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    text = whole[place]

    order = suffix_array(text, windows.longest)
    low, high = _ranges(text, order, windows)
    which = np.flatnonzero(high > low)
    times = high[which] - low[which]
    if not len(times):
        return found
    used = np.repeat(which, times)
    spot = place[order[np.repeat(low[which] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())]]
    owner = np.searchsorted(edges, spot, "right") - 1
    sort = np.lexsort((spot, owner))
    used, spot, owner = used[sort], spot[sort], owner[sort]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for rows in np.split(np.arange(len(owner)), cuts):
        doc = int(owner[rows[0]])
        starts = spot[rows] - edges[doc]
        per_item: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for at, w in zip(starts.tolist(), used[rows].tolist(), strict=True):
            for item, own in windows.uses[w]:
                if item is not None:
                    per_item[item].append((at, own, int(windows.sizes[w])))
        matches = [(item, *run) for item, seen in per_item.items() for run in _longest(seen)]
        found[doc] = (counts[doc], _merge(starts, starts + windows.sizes[used[rows]]), set(per_item), matches)
    return found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of about ``block_bytes``; a block is the only part of the benchmark on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = -(-total // block_bytes) or 1
    for block in range(count):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block) if count > 1 else items
        yield [(r["item_id"], r["text"].encode()) for r in mine.toLocalIterator()]


def find(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with __n_words, __spans (hit words), __items and __matches (longest verbatim matches).

    The four have more underscores where ``documents`` has columns that begin so (``free_prefix``).
    """
    columns = documents.columns
    prefix = free_prefix(columns)
    plain = numbered(documents)
    carried = plain.columns
    text_column = carried[columns.index("text")]
    found = plain.withColumns({name: (F.lit(0) if kind == "long" else F.array()).cast(kind) for name, kind in _FOUND.items()})
    added = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in _FOUND.items()))
    schema = T.StructType(plain.schema.fields + added.fields)
    for i, items in enumerate(_blocks(benchmark, block_bytes)):
        shared = documents.sparkSession.sparkContext.broadcast(Windows.of(items, window))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, text_column):
                results = search(as_bytes(batch.column(text_column)), shared.value)
                old = [batch.column(c).to_pylist() for c in ("spans", "items", "matches")]
                spans, names, matches = [], [], []
                for (_, new_spans, new_items, new_matches), s, n, m in zip(results, *old, strict=True):
                    both = [(x["start"], x["end"]) for x in s] + new_spans
                    merged = _merge(*np.array(both, np.int64).T) if both else []
                    spans.append([{"start": a, "end": b} for a, b in merged])
                    names.append(sorted({*n, *new_items}))
                    matches.append(m + [dict(zip(("item_id", "start", "item_start", "n_words"), x, strict=True)) for x in new_matches])
                kinds = {f.name: f.type for f in batch.schema}
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in carried], pa.array([r[0] for r in results], pa.int64()), pa.array(spans, kinds["spans"]),
                     pa.array(names, kinds["items"]), pa.array(matches, kinds["matches"])],
                    names=[*carried, *_FOUND])

        found = (stage(found) if i else found).mapInArrow(scan, schema)
    return found.toDF(*columns, *[prefix + name for name in _FOUND])


def report(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The verdict on every document, with digests of the items that it holds."""
    found = find(documents.select("doc_id", "text"), benchmark, window=window)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` in which no window of the benchmark occurs."""
    return find(documents, benchmark, window=window).where(F.size(free_prefix(documents.columns) + "spans") == 0).select(*quoted(documents.columns))
