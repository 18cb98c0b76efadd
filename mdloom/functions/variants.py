"""Semi-structured properties: JSON and nodes' attributes as VARIANT, read by path with a type that is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(json: Column) -> Column:
    """JSON as VARIANT; null where it is no JSON."""
    return F.try_parse_json(json)


def at(value: Column, path: str, kind: str = "string") -> Column:
    """What stands at a path such as ``$.a.b[0]``; null where nothing does, or where it is not of this type."""
    return F.try_variant_get(value, path, kind)


def leaves(rows: DataFrame, value: str, keep: list[str], depth: int = 4) -> DataFrame:
    """A row for each scalar in a VARIANT column: ``keep``, ``path`` and ``content``, down to ``depth`` levels.

    Each level unpacks objects and arrays by one step; what is deeper comes back whole, as JSON.
    """
    step = rows.select(*keep, F.lit("$").alias("path"), F.col(value).alias("_v")).where("_v IS NOT NULL")
    done = []
    for level in range(depth + 1):
        kind = F.schema_of_variant("_v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        done.append(step.where(~nested if level < depth else F.lit(True)).select(*keep, "path", F.col("_v").cast("string").alias("content")))
        if level < depth:
            inner = step.where(nested)
            exploded = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("_v").outer()))
            name = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos"), F.lit("]")))
            step = exploded.select(*keep, F.concat("path", name).alias("path"), F.col("value").alias("_v"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def attributes(node: Column, *names: str) -> Column:
    """Attributes of a node row as one VARIANT; those that are null are left out."""
    return F.parse_json(F.to_json(F.struct(*(node[n].alias(n) for n in names))))
