"""Label sets as series identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def series_key(labels: str | Column) -> Column:
    """Text that two label maps share exactly if they hold the same labels in whatever order.

    It is the JSON object of the entries sorted by name, so it can be grouped, joined and used as
    a table key, which a map cannot.  An empty map gives ``{}``; a NULL map is a NULL key, and a
    label with a NULL value counts as absent.
    """
    col = F.col(labels) if isinstance(labels, str) else labels
    some = F.map_filter(col, lambda _, v: v.isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(some))))


def columns_key(columns: list[str]) -> Column:
    """The key of a series that columns identify: like ``series_key`` of a map of their texts."""
    return series_key(F.create_map(*[x for c in sorted(columns) for x in (F.lit(c), F.col(c).cast("string"))]))
