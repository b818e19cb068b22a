"""Typed file readers (S1-S7). No schema is inferred; a value that does not parse is an error."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edupulse.schemas import stored_name


class ReadError(ValueError):
    """A source file does not have the expected columns."""


def csv_header(spark: SparkSession, path: str, *, sep: str = ",") -> list[str]:
    """Column names of a CSV file, from its first line only."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path).columns


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` with its types; under ANSI rules a malformed value fails the job."""
    return df.select(*[_parse(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields])


def _parse(column: Column, kind: T.DataType) -> Column:
    """Text to a typed value; empty text is NULL. ISO-8601 instants may lack an offset (then UTC)."""
    text = F.nullif(F.trim(column), F.lit(""))
    if isinstance(kind, T.StringType):
        return F.nullif(column, F.lit(""))
    if isinstance(kind, T.LongType):
        # Nullable integers are often written with a trailing ".0".
        return F.regexp_replace(text, r"\.0+$", "").cast(kind)
    return text.cast(kind)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None, *,
    sep: str = ",", rename: Callable[[str], str] | Mapping[str, str] = stored_name, multi_line: bool = False,
) -> DataFrame:
    """Columns of ``schema`` (or the given subset) from a CSV file with a header.

    Source headers go through ``rename``; other source columns are pruned. Files of any size are
    split by Spark, so there is no chunk loop. Quotes inside a quoted field are doubled. Line ends inside a
    field need ``multi_line``, which takes each file as one task.
    """
    header = csv_header(spark, path, sep=sep)
    to_name = rename if callable(rename) else lambda h: rename.get(h, h)
    wanted = list(columns or schema.fieldNames())
    missing = set(wanted) - {to_name(h) for h in header}
    if missing:
        raise ReadError(f"{path}: missing column(s) {sorted(missing)}")
    raw_schema = T.StructType([T.StructField(to_name(h), T.StringType()) for h in header])
    raw = (spark.read.schema(raw_schema).option("header", True).option("sep", sep).option("enforceSchema", True)
           .option("escape", '"').option("multiLine", multi_line).option("mode", "FAILFAST").csv(path))
    return cast_to(raw, T.StructType([f for f in schema.fields if f.name in wanted]))


def _text_rows(lines: DataFrame, header_line: str, names: Sequence[str]) -> DataFrame:
    """Data lines parsed as CSV text columns; lines equal to the header are skipped."""
    ddl = ", ".join(f"`{n}` string" for n in names)
    data = lines.where((F.col("value") != header_line) & (F.trim("value") != ""))
    return data.select(F.from_csv("value", ddl, {"mode": "FAILFAST", "escape": '"'}).alias("r")).select("r.*")


def _header_names(line: str) -> list[str]:
    return [h.strip().strip('"') for h in line.split(",")]


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, *, keep_raw: bool = False) -> DataFrame:
    """S3: a CSV whose whole lines are quoted with the inner quotes doubled.

    Lines are unwrapped as text and parsed with ``from_csv``. ``keep_raw`` keeps every source
    column as text, for duplicate removal before pruning; otherwise the columns of ``schema``.
    """
    line = F.regexp_replace("value", r"\r$", "")
    framed = line.startswith('"') & line.endswith('"') & (F.length(line) >= 2)
    body = F.when(framed, F.substring(line, F.lit(2), F.length(line) - 2)).otherwise(line)
    lines = spark.read.text(path).select(F.replace(body, F.lit('""'), F.lit('"')).alias("value"))
    first = lines.first()
    if first is None:
        raise ReadError(f"{path}: empty file")
    rows = _text_rows(lines, first["value"], [stored_name(h) for h in _header_names(first["value"])])
    return rows if keep_raw else cast_to(rows, schema)


def read_tagged(
    spark: SparkSession, sources: Mapping[str, str], schema: T.StructType, *, tag: str = "source_file",
    row_id: str = "source_row_id", date_name: str = "recorded_at",
) -> DataFrame:
    """Several files of one layout with a leading row id, tagged and put together.

    The header may leave the row id out or give it an empty name.
    """
    parts = []
    for label, path in sources.items():
        lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"))
        first = lines.first()
        if first is None:
            raise ReadError(f"{path}: empty file")
        header = _header_names(first["value"])
        data = [date_name if h == "date" else stored_name(h) for h in (header if header[0] else header[1:])]
        rows = _text_rows(lines, first["value"], [row_id, *data])
        parts.append(cast_to(rows.withColumn(tag, F.lit(label)), schema))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def clean_counts(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Integers written with thousands separators."""
    return df.withColumns({c: F.replace(F.col(c), F.lit(","), F.lit("")).cast("long") for c in cols})


def parse_date(df: DataFrame, col: str, fmt: str = "yyyyMMdd") -> DataFrame:
    """Dates in a fixed pattern."""
    return df.withColumn(col, F.to_date(F.col(col), fmt))
