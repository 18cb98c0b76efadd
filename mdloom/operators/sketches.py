"""Approximate aggregates whose sketches are stored by part and merged over parts: distinct values and quantiles.

A part (a day, a source, a shard) is sketched once; any union of parts is answered from the sketches alone, a few KB each, whatever the
rows were. New parts add sketches; nothing is read again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Log2 of the registers of a distinct-count sketch; k of a quantile sketch.
REGISTERS, QUANTILE_K = 14, 400
#: Relative standard error of the distinct count, and normalised rank error of the quantiles, at these sizes.
DISTINCT_ERROR, RANK_ERROR = 1.04 / math.sqrt(1 << REGISTERS), 0.008


def sketched(rows: DataFrame, part: list[str], distinct: str, number: str) -> DataFrame:
    """A row a part: ``n`` rows, ``distinct_sketch`` of one column and ``quantile_sketch`` of a column of whole numbers; nulls count in ``n`` alone."""
    return rows.groupBy(*part).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(distinct, REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_bigint(F.col(number).cast("long"), QUANTILE_K).alias("quantile_sketch"),
    )


def merged(sketches: DataFrame, part: list[str]) -> DataFrame:
    """Sketches of larger parts from those of smaller ones."""
    aggregates = [F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("quantile_sketch").alias("quantile_sketch")]
    return sketches.groupBy(*part).agg(*aggregates) if part else sketches.agg(*aggregates)


def estimates(sketches: DataFrame, part: list[str], ranks: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """``n``, ``distinct`` and ``q50``, ``q90`` (for the ranks given) of each part."""
    quantiles = [F.kll_sketch_get_quantile_bigint("quantile_sketch", F.lit(r)).alias(f"q{round(100 * r)}") for r in ranks]
    return sketches.select(*part, "n", F.hll_sketch_estimate("distinct_sketch").alias("distinct"), *quantiles)
