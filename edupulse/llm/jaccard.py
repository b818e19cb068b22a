"""Links between fingerprints whose texts have a Jaccard similarity of 0.8 or more on five-word shingles.

A text's sketch is its distinct shingle hashes, sixteen band keys of six min-hashes each, and 28
further min-hashes. Shingle hashes are made of the texts that share a band with another one, and of no other. Two texts of similarity s share a band with probability 1 - (1 - s^6)^16 (0.992
at 0.8). A band key shared by at most ``PAIR_ROWS`` fingerprints compares all of them. A key that more
share compares each with one of them; those that are not similar to it go on
under the key and one more min-hash, then two, three and so on, so that no group is ever paired with
itself and the rounds stay few. Every candidate is checked on its whole shingle sets.

Odd cases: texts without words have no shingles and are never linked here; texts of fewer than five
words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from edupulse.llm.staging import among, as_bytes, stage, steps

SHINGLE_WORDS = 5
BANDS, BAND_ROWS, FURTHER = 16, 6, 28
PAIR_ROWS = 16
_STEP = 4096

_RANDOM = np.random.default_rng(20240501)
_ODD = _RANDOM.integers(0, 2**64, BANDS * BAND_ROWS + FURTHER, np.uint64) | np.uint64(1)
_ADD = _RANDOM.integers(0, 2**64, BANDS * BAND_ROWS + FURTHER, np.uint64)
_PLACE = _RANDOM.integers(0, 2**64, SHINGLE_WORDS, np.uint64) | np.uint64(1)
_ROW = _RANDOM.integers(0, 2**64, (BANDS, BAND_ROWS), np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    if len(words) < SHINGLE_WORDS:
        return np.array([xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE_WORDS + 1
    return np.unique(_mix(sum(hashes[i: i + n] * _PLACE[i] for i in range(SHINGLE_WORDS))))


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and further min-hashes of distinct shingle hashes."""
    if not len(found):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = np.full(len(_ODD), 2**64 - 1, np.uint64)
    for at in range(0, len(found), _STEP):
        least = np.minimum(least, (found[at: at + _STEP, None] * _ODD + _ADD).min(0))
    bands = (least[:BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS) * _ROW).sum(1, dtype=np.uint64)
    return _mix(bands), least[BANDS * BAND_ROWS:]


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))


def _shingled(texts: DataFrame) -> DataFrame:
    """text_hash and shingles of every row (text_hash, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = [shingles(text.lower().split()) for text in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), lists(found)], names=["text_hash", "shingles"])

    return texts.mapInArrow(run, "text_hash long, shingles array<long>")


def _sets(sketches: DataFrame, needed: DataFrame, documents: DataFrame | None) -> DataFrame:
    """fp and shingles of one text of every needed fingerprint, the one with the least hash."""
    given = [] if documents is not None else ["shingles"]
    least = among(sketches.select("fp", "text_hash", *given), "fp", needed).groupBy("fp").agg(
        F.min(F.struct("text_hash", *given)).alias("one"))
    least = least.select("fp", "one.*")
    if documents is None:
        return stage(least.drop("text_hash"))
    least = stage(least)
    texts = among(documents.select(F.xxhash64("text").alias("text_hash"), "text"), "text_hash", least.select("text_hash"))
    # Copies combine before the shuffle.
    once = texts.groupBy("text_hash").agg(F.first("text").alias("text"))
    return stage(least.join(_shingled(once), "text_hash").drop("text_hash"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets are similar."""
    needed = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    arrays = among(sets, "fp", needed).select("fp", F.col("shingles").alias("s"))
    one = arrays.select(F.col("fp").alias("a"), F.col("s").alias("x"))
    other = arrays.select(F.col("fp").alias("b"), F.col("s").alias("y"))
    both = F.size("x") + F.size("y")
    fits = 5 * F.least(F.size("x"), F.size("y")) >= 4 * F.greatest(F.size("x"), F.size("y"))
    return (pairs.join(one, "a").join(other, "b").where(fits)
            .where(9 * F.size(F.array_intersect("x", "y")) >= 4 * both).select("a", "b"))


def links(sketches: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between similar fingerprints. ``sketches`` has fp, text_hash, bands and further, and
    shingles unless ``documents`` are given to make them of."""
    members = stage(sketches.select("fp", F.explode("bands").alias("key")).distinct())
    sets = further = None
    found, turn = None, 0
    while True:
        # Each key orders the fingerprints its own way, so bands differ in what they compare with.
        turned = F.min(F.col("fp").bitwiseXOR(F.col("key")))
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), turned.bitwiseXOR(F.col("key")).alias("a")).where("n > 1")
        shared = stage(members.join(sizes, "key"))
        if sets is None:
            needed = shared.select("fp").distinct()
            sets = _sets(sketches, needed, documents)
            # Every text of a fingerprint gives keys, so this is not one row a fingerprint.
            further = stage(among(sketches.select("fp", "further"), "fp", needed).distinct())
        many = shared.where((F.col("n") > PAIR_ROWS) & (F.col("fp") != F.col("a"))).select("key", "a", F.col("fp").alias("b"))
        few = shared.where(F.col("n") <= PAIR_ROWS).groupBy("key").agg(F.collect_list("fp").alias("m"))
        pairs = few.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(
            F.filter("m", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("e")).select("e.*")
        similar = stage(_similar(stage(pairs.unionByName(many.select("a", "b")).distinct()), sets))
        found = similar if found is None else found.unionByName(similar)
        rest = many.join(similar, ["a", "b"], "left_anti").select("key", F.col("b").alias("fp"))
        used = turn * (turn + 1) // 2
        if used < FURTHER:
            more = further.select("fp", F.slice("further", used + 1, turn + 1).alias("more"))
            rest = rest.join(more, "fp").select("fp", F.xxhash64("key", "more").alias("key")).distinct()
        members = stage(rest)
        turn += 1
        if members.isEmpty():
            return found
