"""What differs between two tables: as multisets, and by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def multiset_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of either table that the other has fewer of, with ``change``: added or removed, and ``n``, by how many.

    Both have the same columns; null equals null. Equal rows are counted before they are compared.
    """
    columns = before.columns
    both = before.select(*columns, F.lit(-1).alias("_n")).unionByName(after.select(*columns, F.lit(1).alias("_n")))
    found = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return found.select(*columns, F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change"), F.abs("_n").alias("n"))


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ``change`` (added, removed or changed), ``fields`` (the columns that changed), and structs ``before`` and ``after``.

    Only rows that ``exceptAll`` leaves on either side meet, so that what is equal, which is most, is not joined. Rows that share
    a key are matched in the order of their other columns. Null keys are keys like others.
    """
    columns = [c for c in before.columns if c not in key]
    order = Window.partitionBy(*key).orderBy(*columns) if columns else Window.partitionBy(*key).orderBy(F.lit(0))

    def left(one: DataFrame, other: DataFrame, side: str) -> DataFrame:
        rows = one.select(*key, *columns).exceptAll(other.select(*key, *columns))
        return rows.withColumn("_rank", F.row_number().over(order)).select(*(F.col(k).alias(f"_{side}_{k}") for k in key), F.col("_rank").alias(f"_{side}_rank"), F.struct(*columns).alias(side))

    a, b = left(before, after, "before"), left(after, before, "after")
    same = F.col("_before_rank") == F.col("_after_rank")
    for k in key:
        same = same & F.col(f"_before_{k}").eqNullSafe(F.col(f"_after_{k}"))
    met = a.join(b, same, "full")
    removed, added = F.col("after").isNull(), F.col("before").isNull()
    differ = [F.when(~F.col("before")[c].eqNullSafe(F.col("after")[c]), F.lit(c)) for c in columns]
    fields = F.when(removed | added, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*differ)) if differ else F.array().cast("array<string>"))
    keys = [F.when(added, F.col(f"_after_{k}")).otherwise(F.col(f"_before_{k}")).alias(k) for k in key]
    return met.select(*keys, F.when(added, "added").when(removed, "removed").otherwise("changed").alias("change"), fields.alias("fields"), "before", "after")
