"""Keyed state of a stream as a table: a bucketed base, small deltas, merged on read.

Layout under one path: ``base/<version>`` and ``delta/<version>`` hold one row per key, partitioned by a hash bucket of
the key; ``commit/<version>`` holds one JSON row that names the base and the deltas in force. A version is published by the
rename of its commit file, so a crash before it leaves nothing visible and a replayed batch writes the same folders
again. Every ``compact_every`` deltas the base is rewritten. A batch therefore reads the buckets of its own keys in the base
and at most ``compact_every`` deltas, however long the stream has run.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, VERSION = "_bucket", "_version"


@dataclass(frozen=True)
class Commit:
    """What a version consists of; ``extra`` carries what a sink wants to know of the last batch."""

    version: int = -1
    base: int | None = None
    deltas: tuple[int, ...] = ()
    extra: dict = field(default_factory=dict)


class KeyedState:
    """The table at ``path`` with rows of ``schema``, one per ``keys``."""

    def __init__(self, spark: SparkSession, path: str, *, schema: T.StructType, keys: Sequence[str], buckets: int = 32, compact_every: int = 8) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.buckets, self.compact_every = buckets, compact_every
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def last_commit(self, before: int | None = None) -> Commit:
        """The newest commit, or the newest of a version below ``before``."""
        folder = self._path(f"{self.path}/commit")
        if not self._fs.exists(folder):
            return Commit()
        versions = [int(name[:-5]) for s in self._fs.listStatus(folder) if (name := s.getPath().getName()).endswith(".json")]
        versions = [v for v in versions if before is None or v < before]
        if not versions:
            return Commit()
        stream = self._fs.open(self._path(f"{self.path}/commit/{max(versions)}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Commit(found["version"], found["base"], tuple(found["deltas"]), found["extra"])

    def bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _part(self, kind: str, version: int) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{version}").withColumn(VERSION, F.lit(version))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read(self, commit: Commit | None = None, of: DataFrame | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows in force, one per key; with ``of``, at least those of its keys, with ``buckets``, those of these buckets."""
        commit = commit or self.last_commit()
        parts = [self._part("delta", v) for v in commit.deltas]
        if commit.base is not None:
            parts.append(self._part("base", commit.base))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if of is not None:
            # At most ``buckets`` numbers; they prune whole folders.
            buckets = [r[0] for r in of.select(self.bucket().alias("b")).distinct().collect()]
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(list(buckets)))
        if len(parts) == 1:
            return rows.select(*self.schema.names)
        # Rows of a key are at most one a part, so one shuffle and one sort find the newest.
        newest = Window.partitionBy(*self.keys).orderBy(F.col(VERSION).desc())
        rows = rows.repartition(*self.keys).withColumn("_rank", F.row_number().over(newest))
        return rows.where("_rank = 1").select(*self.schema.names)

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        # A bucket is one file, or a few even ones where it is large, and not one of every task.
        rows = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket()).hint("rebalance", F.col(BUCKET))
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{kind}/{version}")

    def publish(self, version: int, changed: DataFrame, extra: dict | None = None) -> Commit:
        """Makes ``changed`` (one row per key) the newest rows of their keys."""
        old = self.last_commit(before=version)
        self._write(changed, "delta", version)
        new = Commit(version, old.base, (*old.deltas, version), extra or {})
        if len(new.deltas) >= self.compact_every:
            self._write(self.read(new), "base", version)
            new = Commit(version, version, (), new.extra)
        draft, final = (self._path(f"{self.path}/commit/{version}.{end}") for end in ("draft", "json"))
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(asdict(new)).encode()))
        stream.close()
        self._fs.delete(final, False)
        if not self._fs.rename(draft, final):
            raise OSError(f"cannot publish {final}")
        self._drop_unused(new, old)
        return new

    def _drop_unused(self, new: Commit, old: Commit) -> None:
        """Folders that neither this version nor the one before it reads."""
        used = {"delta": {*new.deltas, *old.deltas, new.version}, "base": {new.base, old.base}}
        for kind, versions in used.items():
            folder = self._path(f"{self.path}/{kind}")
            if self._fs.exists(folder):
                for status in self._fs.listStatus(folder):
                    if (name := status.getPath().getName()).isdigit() and int(name) < new.version and int(name) not in versions:
                        self._fs.delete(status.getPath(), True)
