"""Parsing a stream: the kernel keeps no state across documents, so the batch operator serves as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel.constructs import Constructs
from ..operators.parse import parse_markdown


def parse_stream(docs: DataFrame, constructs: Constructs | None = None, **options) -> DataFrame:
    """The nodes of documents as they arrive."""
    return parse_markdown(docs, constructs, **options)


def counts_by_window(docs: DataFrame, time_col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Block starts per window of event time, natively from line shapes; late rows within the watermark count."""
    from ..functions.lexical import line_start, split_lines

    lines = docs.withWatermark(time_col, late).select(time_col, F.explode(split_lines(F.col("text"))).alias("line"))
    kinds = lines.withColumn("kind", line_start(F.col("line"), F.lit(False)))
    return kinds.groupBy(F.window(time_col, window), "kind").agg(F.count("*").alias("n"))
