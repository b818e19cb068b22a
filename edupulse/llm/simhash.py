"""Near duplicates by SimHash, candidates by pigeonring.

Fingerprints are 64 bits in a ring of three segments. If two differ in at most 2 bits, some segment
starts a chain whose cumulative differences stay within the proportional budgets floor(l · 2 / 3):
none in the first segment, at most one in the first two, at most two in all three. "At most one in
the second segment" means that one of its halves is equal, so a chain is looked up by its whole
first segment and half of the second: six keys of about 32 bits a fingerprint. A key's other
fingerprints are candidates; their chains are checked against the budgets before the full distance.

A key that over ``PAIR_ROWS`` fingerprints share is not compared pairwise: each of them emits the
values within one bit of it (over the bits that the key leaves open), and two share such a value if
and only if they are within two bits. So every key costs a bounded number of rows per member, and
no link is lost.

Only distinct fingerprints are linked; documents join their component at the end.

``near_dedup`` links texts of a similarity of 0.8 or more (five-word shingles) as well: 64-bit
fingerprints of such texts mostly differ in more bits than chains can search for (``jaccard``).

Odd cases: a null text has no words and, like every text without words, fingerprint zero; null
doc_ids rank after all others; repeated rows are in one component; an empty table gives no rows;
other columns are not read (``near_dedup`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from edupulse.llm import jaccard
from edupulse.llm.components import connected_components
from edupulse.llm.staging import as_bytes, stage, steps

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
PAIR_ROWS = 32

_SEGMENTS = (22, 21, 21)
_LAST = 2**63 - 1


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _segment_masks() -> list[int]:
    masks, low = [], 0
    for width in _SEGMENTS:
        masks.append(((1 << width) - 1) << low)
        low += width
    return masks


def _tables() -> list[tuple[int, int]]:
    """(bits of the key, bits of the chain's second segment) of the six lookups."""
    masks, tables = _segment_masks(), []
    for i, first in enumerate(masks):
        second = masks[(i + 1) % 3]
        low = (second & -second).bit_length() - 1
        lower = ((1 << _SEGMENTS[(i + 1) % 3] // 2) - 1) << low
        tables += [(first | lower, second), (first | second & ~lower, second)]
    return tables


TABLES = _tables()


def fingerprints(documents: DataFrame, *, shingle_words: int = SHINGLE_WORDS, seed: int = SEED, sketches: bool = False, sets: bool = True) -> DataFrame:
    """Every row's doc_id (null: the largest long), text hash and fingerprint; with ``sketches`` also
    the shingles (not without ``sets``), bands and further min-hashes that ``jaccard`` links by."""
    more = [*(["shingles"] if sets else []), "bands", "further"] if sketches else []

    def one(words: list[bytes]) -> list[int]:
        if not words:
            return []
        if len(words) <= shingle_words:
            return [xxh64_intdigest(b" ".join(words), seed)]
        return [xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*[words[i:] for i in range(shingle_words)], strict=False))]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = np.zeros(batch.num_rows, np.uint64)
            sketched = []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                words = text.lower().split()
                hashes = np.array(one(words), ">u8")
                if len(hashes):
                    ones = np.zeros(64, np.int64)
                    for at in range(0, len(hashes), 4096):
                        part = hashes[at: at + 4096]
                        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                    out[i] = int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")
                if sketches:
                    found = jaccard.shingles(words)
                    sketched.append((*([found] if sets else []), *jaccard.sketch(found)))
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(out.view(np.int64))]
            if sketches:
                columns += [jaccard.lists(list(arrays)) for arrays in zip(*sketched, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # Spark's xxhash64 of a null is the seed, as of an empty text.
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    names = ["doc_id", "text_hash", "fp", *more]
    return rows.mapInArrow(prints, ", ".join(f"{n} {'long' if i < 3 else 'array<long>'}" for i, n in enumerate(names)))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly those of the distinct ``fp`` that chains of at most 2 differing bits connect."""
    def pick(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(_signed(v)) for v in values]), F.col("t") + 1)

    fp = F.col("fp")
    keys = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(bits))).alias("key")) for t, (bits, _) in enumerate(TABLES)])).alias("_k")).select("fp", "_k.*")
    sizes = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(sizes, ["t", "key"])

    def near(x: Column, y: Column) -> Column:
        differs = x.bitwiseXOR(y)
        in_budget = F.bit_count(differs.bitwiseAND(F.col("second"))) <= 1
        return (y > x) & in_budget & (F.bit_count(differs) <= MAX_BITS)

    few = (shared.where(F.col("n") <= PAIR_ROWS).groupBy("t", "key").agg(F.collect_list("fp").alias("m"))
           .withColumn("second", pick([second for _, second in TABLES])))
    pairs = few.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(
        F.filter("m", lambda y: near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("e")).select("e.*")

    # At most one value per open bit and the fingerprint itself, so a group below holds few rows by construction.
    open_bits = [[0, *[_signed(1 << b) for b in range(64) if not bits >> b & 1]] for bits, _ in TABLES]
    flips = F.element_at(F.array(*[F.array(*[F.lit(v).cast("long") for v in row]) for row in open_bits]), F.col("t") + 1)
    around = (shared.where(F.col("n") > PAIR_ROWS).withColumn("_flip", F.explode(flips))
              .groupBy("t", fp.bitwiseXOR(F.col("_flip")).alias("value")).agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1))
    starred = around.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    starred = starred.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return pairs.unionByName(starred).distinct()


def near_duplicates(documents: DataFrame, *, similar: bool = False) -> DataFrame:
    """doc_id, text_hash, fp, component (its least fp) and component_id (the least doc_id reachable) of every row.

    ``similar`` links texts of a Jaccard similarity of 0.8 or more too. Several components share a
    component_id where doc_ids are null or repeated.
    """
    sketched = stage(fingerprints(documents, sketches=similar, sets=False))
    prints = sketched.select("doc_id", "text_hash", "fp")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(classes.select("fp"))
    parts = connected_components(edges.unionByName(jaccard.links(sketched, documents)) if similar else edges)
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    labels = named.groupBy("component").agg(F.min("least").alias("component_id"))
    component = named.join(labels, "component").select("fp", "component", "component_id")
    return prints.join(component, "fp")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    def back(c: str) -> Column:
        return F.when(F.col(c) != _LAST, F.col(c)).alias(c)

    return near_duplicates(documents).select(
        back("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), back("component_id"))


def near_dedup(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay: of every component, similar texts included, the one with
    the least doc_id (then least text hash), once."""
    rows = near_duplicates(documents, similar=True)
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    stay = first.select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash")).distinct()
    # The row travels as one column, so no name of the table can clash.
    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in documents.columns]).alias("row")
    keyed = documents.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("hash"))
    # Equal rows are neighbours after the join, whose order the window shares.
    turn = Window.partitionBy("id", "hash").orderBy("id", "hash")
    return keyed.join(stay, ["id", "hash"]).withColumn("turn", F.row_number().over(turn)).where("turn = 1").select("row.*")
