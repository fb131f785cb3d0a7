"""Columns that are computed once, however often later steps read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions the optimizer must not repeat.

    A filter on a computed column, or the filter that Spark adds to an explode,
    is pushed below the projection by repeating the expression. For expressions
    that walk a whole document that means walking it again. Filters stay above
    a generator of one row, so the columns come from one.
    """
    kept = [c for c in rows.columns if c not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select(*kept, F.inline(F.array(values)))
