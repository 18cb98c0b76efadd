"""Streams with state: sessions, repeated rows, and counts that follow the newest version of each document.

All state is keyed, bounded by a watermark or by the number of live documents, and kept in the checkpoint: a query that is started again
goes on where it stopped, and counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import lexical as lx
from ..sources.store import scratch

DELTAS = "doc_id bigint, label string, delta bigint, version bigint"
#: The state store that keyed processors need.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def sessions(events: DataFrame, keys: list[str], time_col: str, gap: str = "30 minutes", late: str = "2 hours", **measures: Column) -> DataFrame:
    """Runs of each key's rows that are less than ``gap`` apart: ``keys``, started, ended (the last row and ``gap``), n and ``measures``.

    Rows behind the watermark are dropped; rows that come late but before it merge the sessions they lie between. Serves
    streams and tables alike.
    """
    out = events.withWatermark(time_col, late).groupBy(*keys, F.session_window(time_col, gap).alias("w")).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in measures.items()))
    return out.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", *measures)


def without_repeats(rows: DataFrame, keys: list[str], time_col: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key; rows that repeat it within ``late`` go. State is let go by the watermark."""
    return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def label_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, version, labels): how many lines of each class a version of a document has, as a map."""
    kinds = F.transform(lx.split_lines(F.coalesce("text", F.lit(""))), lambda x: F.coalesce(lx.line_start(x, F.lit(False)), F.lit("Text")))
    counted = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)).cast("long"))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("version").cast("long").alias("version"), F.when(F.col("deleted"), F.create_map().cast("map<string,bigint>")).otherwise(counted).alias("labels"))


class Newest(StatefulProcessor):
    """Keeps the labels of each document's newest version, and tells by how much they change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "version bigint, labels map<string, bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        (doc_id,) = key
        version, labels = self.held.get() if self.held.exists() else (None, {})
        before, start = dict(labels or {}), version
        now = before
        for batch in rows:
            for v, own in zip(batch["version"], batch["labels"], strict=True):
                if version is None or v > version:  # of rows with one version, the first that comes counts
                    version, now = int(v), dict(own)
        if version != start:
            self.held.update((version, {k: int(n) for k, n in now.items()}))
            deltas = [(doc_id, k, int(now.get(k, 0)) - int(before.get(k, 0)), version) for k in sorted({*before, *now}) if now.get(k, 0) != before.get(k, 0)]
            if deltas:
                yield pd.DataFrame(deltas, columns=["doc_id", "label", "delta", "version"])

    def close(self) -> None:
        pass


def label_changes(docs: DataFrame) -> DataFrame:
    """What each new version of a document (doc_id, version, text, deleted) adds to and takes from the number of its lines by class.

    The sum of all deltas by label is what the newest versions hold, whatever order versions come in, and however often.
    Needs the state store of ``PROVIDER``.
    """
    return label_counts(docs).groupBy("doc_id").transformWithStateInPandas(Newest(), DELTAS, "append", "none")


def run_to_end(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None, **conf: str) -> DataFrame:
    """What a stream has given by now for all that its source has, as a table; in complete mode the last answer.

    ``folder`` holds the answer and the checkpoint: given again, the query goes on where it stopped.
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, name)
    for key, value in conf.items():
        spark.conf.set(key, value)
    if mode == "complete":
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))
    else:
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    writer.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
