"""Name-based (version 5) UUIDs as a column expression."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5_of(name: Column) -> Column:
    """uuid5 in the DNS namespace, canonical text form."""
    namespace = F.unhex(F.lit(uuid.NAMESPACE_DNS.hex))
    digest = F.sha1(F.concat(namespace, F.encode(name, "UTF-8")))
    # Version nibble 5 and the RFC 4122 variant bits replace two digits of the digest.
    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab"]),
        (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1,
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def uuid5_col(dataset: str | Column, source_id: Column) -> Column:
    """Stable identity of one ``(dataset, id)`` pair."""
    prefix = F.lit(dataset) if isinstance(dataset, str) else dataset
    return uuid5_of(F.concat(prefix, F.lit(":"), source_id.cast("string")))
