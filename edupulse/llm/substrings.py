"""Removal of long repeated passages, found by recompression.

Recompression names runs of equal symbols and then pairs of symbols, round after round, starting
from words. A pair is named if its first symbol is of the left class and its second of the right
class, classes being bits of the symbols, so a name depends only on the words below it: a name is a
mixing hash of its parts, the same in every task, and needs no exchange. Equal passages therefore get
the same symbols except next to their ends, where a run or a partner may lie outside. What is
inside a window of ``WINDOW`` words whatever surrounds it is its interior; its longest interior
symbol (the least hash among equally long ones) is the window's anchor. Equal windows have equal
anchors. A window without interior (long runs of one word) is its own anchor.

Spark rounds then follow the anchors, from coarse to fine:

1. symbols that anchor windows of more than one document;
2. chunks (all words of consecutive windows with one anchor): equal chunks resolve all their
   windows at once, since the least document of a chunk precedes the others;
3. single windows, for chunks whose anchor also lies in a different chunk.

A window is identified by its anchor and a 64-bit polynomial hash of its words, together 120 bits.

Odd cases: a null text has no words; texts under ``WINDOW`` words lose none; a null doc_id ranks after all others and
null doc_ids do not precede each other; rows with equal doc_id do not precede each other; repeated
rows are judged alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from edupulse.llm.staging import as_bytes, stage, steps

WINDOW = 50
ROUNDS = 4
_LAST = 2**63 - 1
_NO_WORDS = hashlib.sha256(b"").hexdigest()

_ANCHORS = "array<struct<symbol:long,chunk:long,first:int,last:int>>"
_SPANS = "array<struct<start:int,end:int>>"

# Odd 64-bit multipliers.
_BASE, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX_A, _MIX_B, _MIX_C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * _MIX_A + b
    z ^= z >> np.uint64(31)
    z *= _MIX_B
    z ^= z >> np.uint64(29)
    z *= _MIX_C
    return z ^ (z >> np.uint64(32))


def _recompress(words: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Names runs and pairs of ``words`` (of documents ``doc``) for ``ROUNDS`` rounds, following the
    interiors of the windows that begin at word ``first`` and end at word ``last``.

    Yields per round: symbols, words under each, and each window's first and last interior symbol
    (first > last: none).
    """
    symbol, size = words, np.ones(len(words), np.int64)
    for turn in range(ROUNDS):
        # Runs.
        starts = np.ones(len(symbol), bool)
        starts[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(starts)
        length = np.diff(np.append(begin, len(symbol)))
        run = np.cumsum(starts) - 1
        size = np.add.reduceat(size, begin)
        doc = doc[begin]
        symbol = np.where(length > 1, _mix(symbol[begin], length.astype(np.uint64)), symbol[begin])
        # The runs at the ends may go on outside.
        count = len(symbol)
        first, last = run[np.minimum(first, len(run) - 1)] + 1, run[np.maximum(last, 0)] - 1
        # Pairs.
        right = (symbol * (_MIX_C + np.uint64(2 * turn))) >> np.uint64(63) == 1
        joined = np.zeros(count, bool)  # with the next
        joined[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
        # At the start a right symbol, at the end a left one may have its partner outside.
        first = first + right[np.minimum(first, count - 1)]
        last = last - ~right[np.maximum(last, 0)]
        keep = np.ones(count, bool)
        keep[1:] = ~joined[:-1]
        at = np.flatnonzero(keep)
        pair = joined[at]
        following = np.minimum(at + 1, count - 1)
        paired = _mix(symbol[at], symbol[following] ^ _MIX_B)
        size = size[at] + np.where(pair, size[following], 0)
        symbol, doc = np.where(pair, paired, symbol[at]), doc[at]
        new = np.cumsum(keep) - 1
        none = first > last
        first, last = new[np.minimum(first, count - 1)], new[np.clip(last, 0, count - 1)]
        first = np.where(none, len(symbol), first)
        last = np.where(none, -1, last)
        yield symbol, size, first, last


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]) for each range."""
    out = np.empty(len(first), values.dtype)
    level, table, width = np.frexp(last - first + 1)[1] - 1, values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        rows = np.flatnonzero(level == k)
        out[rows] = np.minimum(table[first[rows]], table[last[rows] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


class Hashed:
    """The words of a step's texts as numbers, and polynomial hashes of any of their runs."""

    def __init__(self, texts: list[bytes]):
        self.split = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in self.split], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        self.words = np.array([xxh64_intdigest(w, 7) for ws in self.split for w in ws], np.uint64)
        power = np.full(len(self.words) + 1, _BASE, np.uint64)
        back = np.full(len(self.words) + 1, _BACK, np.uint64)
        power[:1] = back[:1] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * np.cumprod(power)[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.back[start]
        return _mix(value, (end - start).astype(np.uint64))


def anchors(texts: list[bytes], window: int = WINDOW) -> tuple[Hashed, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashed, document, symbol, chunk hash, first window, last window) of the chunks of ``texts``.

    Windows are numbered by their first word, from 0 in each document.
    """
    hashed = Hashed(texts)
    windows = np.maximum(hashed.counts - window + 1, 0)
    doc = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(hashed.begin[:-1], windows)
    symbol = np.zeros(len(doc), np.uint64)
    if len(doc):
        # The levels from the second last on: lower symbols are single frequent words too often.
        for turn, (names, size, first, last) in enumerate(_recompress(hashed.words, np.repeat(np.arange(len(texts)), hashed.counts), start, start + window - 1)):
            if turn >= ROUNDS - 2:
                have = np.flatnonzero(first <= last)
                value = ((255 - np.minimum(size, 255)).astype(np.uint64) << np.uint64(56)) | (names >> np.uint64(8))
                symbol[have] = _least(value, first[have], last[have])
        alone = np.flatnonzero(symbol == 0)
        symbol[alone] = hashed.of(start[alone], start[alone] + window) | np.uint64(1)
    new = np.ones(len(doc), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(doc)) - 1 if len(at) else at
    chunk = hashed.of(start[at], start[ends] + window)
    base = hashed.begin[doc[at]]
    return hashed, doc[at], symbol[at], chunk, start[at] - base, start[ends] - base


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows as (doc_id, text_hash, text); a null doc_id is the largest long."""
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def described(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``_keyed``: n_words, the digest of its words, and its chunks."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            hashed, doc, symbol, chunk, first, last = anchors(as_bytes(batch.column("text")), window)
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            parts = pa.StructArray.from_arrays(
                [pa.array(symbol.view(np.int64)), pa.array(chunk.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                names=["symbol", "chunk", "first", "last"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(hashed.counts), pa.array([_digest(w) for w in hashed.split]),
                 pa.ListArray.from_arrays(pa.array(edges, pa.int32()), parts)], names=["doc_id", "text_hash", "n_words", "digest", "anchors"])

    return _keyed(documents).mapInArrow(describe, f"doc_id long, text_hash long, n_words long, digest string, anchors {_ANCHORS}")


def _open_windows(documents: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """The single windows of the chunks in ``rows`` (doc_id, text_hash, symbol, first, last). Repeated rows name a chunk once."""
    wanted = rows.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("symbol", "first", "last")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            hashed = Hashed(as_bytes(batch.column("text")))
            lists = batch.column("wanted")
            parts, owner = lists.flatten(), np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            symbol, first, last = (parts.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("symbol", "first", "last"))
            times = last - first + 1
            each = np.repeat(np.arange(len(owner)), times)
            at = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            start = hashed.begin[owner[each]] + at
            row = pa.array(owner[each])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("text_hash").take(row), pa.array(symbol[each]),
                 pa.array(hashed.of(start, start + window).view(np.int64)), pa.array(at.astype(np.int32))],
                names=["doc_id", "text_hash", "symbol", "words", "start"])

    return (_keyed(documents).join(wanted, ["doc_id", "text_hash"])
            .mapInArrow(cut, "doc_id long, text_hash long, symbol long, words long, start int"))


def repeated_spans(documents: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, start, end): word ranges that an earlier document repeats."""
    chunks = found.select("doc_id", "text_hash", F.explode("anchors").alias("_a")).select("doc_id", "text_hash", "_a.*")
    shared = chunks.groupBy("symbol").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).where("_low < _high").select("symbol")
    chunks = stage(chunks.join(shared, "symbol"))
    sources = stage(chunks.groupBy("symbol", "chunk").agg(F.min("doc_id").alias("source")))
    varied = sources.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol")
    placed = chunks.join(sources, ["symbol", "chunk"])
    whole = placed.where("doc_id > source").select("doc_id", "text_hash", F.col("first").alias("start"), (F.col("last") + window).alias("end"))
    unsettled = placed.where("doc_id = source").join(varied, "symbol").select("doc_id", "text_hash", "symbol", "first", "last")
    single = stage(_open_windows(documents, unsettled, window))
    earliest = single.groupBy("symbol", "words").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("_high")).where("source < _high").drop("_high")
    late = single.join(earliest, ["symbol", "words"]).where("doc_id > source").select("doc_id", "text_hash", "start", (F.col("start") + window).alias("end"))
    return whole.unionByName(late)


def _merged(spans: DataFrame) -> DataFrame:
    """Per document the union of its spans, in order, and its words."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unions, totals = [], []
            for each in batch.column("spans").to_pylist():
                out: list[list[int]] = []
                for a, b in sorted((s["start"], s["end"]) for s in each):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], b)
                    else:
                        out.append([a, b])
                unions.append([{"start": a, "end": b} for a, b in out])
                totals.append(sum(b - a for a, b in out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(unions, batch.schema.field("spans").type), pa.array(totals, pa.int64())],
                names=["doc_id", "text_hash", "spans", "n_removed"])

    grouped = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return grouped.mapInArrow(merge, f"doc_id long, text_hash long, spans {_SPANS}, n_removed long")


_KEPT = "doc_id long, n_words long, n_removed long, kept string"
_KEPT_NAMES = ["doc_id", "n_words", "n_removed", "kept"]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        kept, counts = [], []
        for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            words, rest, at = text.split(), [], 0
            for span in spans:
                rest += words[at: span["start"]]
                at = span["end"]
            kept.append(b" ".join(rest + words[at:]).decode())
            counts.append(len(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), batch.column("n_removed"), pa.array(kept, pa.string())], names=_KEPT_NAMES)


def remove_repeats(documents: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id and text of every row without the words that an earlier document repeats; texts that lose none are unchanged."""
    spans = stage(_merged(repeated_spans(documents, stage(described(documents, window)), window)))
    keyed = _keyed(documents)
    changed = keyed.join(spans, ["doc_id", "text_hash"]).mapInArrow(_kept, _KEPT)
    same = keyed.join(spans, ["doc_id", "text_hash"], "left_anti")
    both = same.select("doc_id", "text").unionByName(changed.select("doc_id", F.col("kept").alias("text")))
    return both.withColumn("doc_id", F.when(F.col("doc_id") != _LAST, F.col("doc_id")))


def report(documents: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every row."""
    found = stage(described(documents, window))
    spans = stage(_merged(repeated_spans(documents, found, window)))
    key = ["doc_id", "text_hash"]
    counted = found.select(*key, "n_words", "digest").join(spans.select(*key, "n_removed"), key, "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    # Only texts that lose a part are needed again.
    settled = counted.where("n_removed = 0 or n_removed = n_words").select(
        "doc_id", "n_words", "n_removed", F.when(F.col("n_removed") == 0, F.col("digest")).otherwise(_NO_WORDS).alias("kept_sha256"))
    partly = counted.where("n_removed > 0 and n_removed < n_words").select(*key).distinct().join(spans, key)
    changed = _keyed(documents).join(partly, key).mapInArrow(_kept, _KEPT).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    both = settled.unionByName(changed)
    return both.withColumn("doc_id", F.when(F.col("doc_id") != _LAST, F.col("doc_id")))
