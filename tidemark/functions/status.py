"""Value mappings and threshold colours for status panels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the status panels: value 0 reads DOWN (red), 1 reads UP (green);
# threshold steps start red and turn green from 1.
UP_DOWN_MAPPING = {0: ("DOWN", "red"), 1: ("UP", "green")}
UP_DOWN_THRESHOLDS = [(None, "red"), (1.0, "green")]


def map_values(value: Column, mapping: dict = UP_DOWN_MAPPING) -> Column:
    """Text for exact values; NULL when the value has no mapping."""
    out = None
    for v, (text, _) in mapping.items():
        out = (F.when(value == v, F.lit(text)) if out is None else out.when(value == v, F.lit(text)))
    return out


def threshold_color(value: Column, steps=UP_DOWN_THRESHOLDS) -> Column:
    """Colour of the highest step whose bound is <= value (first step has no bound)."""
    base = steps[0][1]
    out = F.lit(base)
    for bound, color in steps[1:]:
        out = F.when(value >= F.lit(bound), F.lit(color)).otherwise(out)
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(out)
