"""Totals at several levels of detail in one pass: rows expand to the levels they count for, and are summed on the way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(rows: DataFrame, dims: list[str], measures: dict[str, Column], how: str | list[list[str]] = "cube") -> DataFrame:
    """``measures`` by ``dims``: every combination (cube), every prefix (rollup), or the sets named, the empty one for all rows.

    ``level`` says which dimensions are summed over, one bit each, the last the lowest: it tells a subtotal from a null value.
    """
    aggregates = [c.alias(name) for name, c in measures.items()]
    level = F.grouping_id().cast("long").alias("level")
    if how == "cube":
        out = rows.cube(*dims).agg(level, *aggregates)
    elif how == "rollup":
        out = rows.rollup(*dims).agg(level, *aggregates)
    else:
        out = rows.groupingSets([[F.col(c) for c in s] for s in how], *dims).agg(level, *aggregates)
    return out.select(*dims, "level", *measures)


def size_class(chars: Column, bounds: tuple[int, ...] = (200, 2000), names: tuple[str, ...] = ("short", "middle", "long")) -> Column:
    """A class by size: the first name below the first bound, and so on; null has none."""
    cases = list(zip(bounds, names, strict=False))
    out = reduce(lambda c, x: c.when(chars < x[0], x[1]), cases[1:], F.when(chars < cases[0][0], cases[0][1]))
    return out.when(chars.isNotNull(), names[-1])
