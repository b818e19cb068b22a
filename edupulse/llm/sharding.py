"""Reproducible global shuffle by a keyed permutation.

Rows get global numbers 0 … n-1 in the order of (doc_id, size, checksum). A Feistel network permutes
[0, 2^2w) ⊇ [0, n); a number that lands at n or above is sent through it again until it falls
below (cycle walking), which permutes [0, n). Row r goes to shard π(r) mod k, slot π(r) div k:
shards differ by at most one row, and either way round needs n, k and the key only, no table.

Odd cases: a null text has size 1 and the checksum of nothing; null doc_ids are numbered first;
repeated rows are interchangeable; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edupulse.llm.staging import text_or_empty
from edupulse.operators.ordinal import global_ordinal

SHARDS = 8
SEED = 20_240_601
ROUNDS = 6
_MULTIPLIER = 48_271
_PRIME = 2_147_483_647


def half_bits(n: int) -> int:
    """Bits of half a number: the domain 2^(2w) holds n and is under 4n (16 at least)."""
    return max(2, (max(n - 1, 1).bit_length() + 1) // 2)


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[int]:
    keys, state = [], seed % _PRIME or 1
    for _ in range(rounds):
        state = state * 16_807 % _PRIME
        keys.append(state)
    return keys


def _network(x: np.ndarray, w: int, keys: list[int]) -> np.ndarray:
    mask = (1 << w) - 1
    left, right = x >> w, x & mask
    for key in keys:
        mixed = (right * _MULTIPLIER + key) % _PRIME
        left, right = right, left ^ (mixed * mixed % _PRIME & mask)
    return (left << w) | right


def _inverse_network(x: np.ndarray, w: int, keys: list[int]) -> np.ndarray:
    mask = (1 << w) - 1
    left, right = x >> w, x & mask
    for key in reversed(keys):
        mixed = (left * _MULTIPLIER + key) % _PRIME
        left, right = right ^ (mixed * mixed % _PRIME & mask), left
    return (left << w) | right


def _walk(step, x: np.ndarray, n: int, seed: int) -> np.ndarray:
    w, keys = half_bits(n), round_keys(seed)
    out = step(x.astype(np.int64), w, keys)
    while len(far := np.flatnonzero(out >= n)):
        out[far] = step(out[far], w, keys)
    return out


def permute(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    return _walk(_network, x, n, seed)


def unpermute(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    return _walk(_inverse_network, x, n, seed)


def row_of(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The global row number at a place."""
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def to(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    return to(number)


def shard_documents(documents: DataFrame, *, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32 and the place of each document; the text itself is not shuffled."""
    text = text_or_empty()
    slim = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = global_ordinal(slim, order_by=["doc_id", "size", "text_crc32"], name="row_number")
    n = numbered.count()
    return (numbered.withColumn("_to", permuted(F.col("row_number"), n, seed))
            .select("doc_id", "size", "text_crc32", "row_number", (F.col("_to") % shards).cast("int").alias("shard"), F.floor(F.col("_to") / shards).cast("long").alias("slot")))
