"""List literals stored as text, such as ``['8.F.B.5', '7.G.B.6']`` (F1, F2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ITEM = r"(?:'[^']*'|\"[^\"]*\")"
_LIST = rf"^\s*\[\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*,?)?\s*\]\s*$"


def parse_list(literal: Column) -> Column:
    """Array of the quoted items; NULL when the text is not a list of quoted items."""
    items = F.regexp_extract_all(literal, F.lit(f"({_ITEM})"), F.lit(1))
    bare = F.transform(items, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.when(literal.rlike(_LIST), bare)


def first_item(literal: Column) -> Column:
    """First item, or NULL when empty or malformed."""
    return F.get(parse_list(literal), F.lit(0))


def contains_item(literal: Column, item: Column) -> Column:
    """Whole-item membership (never a substring match); false when malformed."""
    return F.coalesce(F.array_contains(parse_list(literal), item), F.lit(False))
