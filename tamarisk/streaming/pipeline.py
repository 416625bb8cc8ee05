"""Offers as a stream: each micro-batch is matched against the catalogue, written and logged; then a batch job finishes.

A file source and a checkpoint folder give exactly-once progress: a restarted stream goes on after the last whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.pricing import decision


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def priced_stream(offers: DataFrame, catalogue: DataFrame, out: str, checkpoint: str, ledger: str | None = None) -> StreamingQuery:
    """Join the stream of (product_id, store, price) with the catalogue, decide prices and write each batch under its own id, so that
    a batch that is done again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.join(catalogue, batch.product_id == catalogue.our_id, "left")
        rows = rows.withColumn("d", decision("our_price", "price"))
        rows = rows.select("product_id", "store", "price", "our_price", "d.*")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if ledger:
            counts = batch.agg(F.count("*").alias("n")).withColumn("batch_id", F.lit(number))
            counts.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return offers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Drop repeats of a key that arrive within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def progress(stream: DataFrame, ts: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows by status and tumbling window, final once the watermark has passed."""
    w = F.window(ts, window)
    counted = stream.withWatermark(ts, late).groupBy(w, "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "status", "n")


def status_changes(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, event_id, from_status, to_status) whenever an entity's status changes, with the last status as state."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        out = []
        for event, status in zip(rows.event_id, rows.status, strict=True):
            if status != last:
                out.append((k[0], event, last, status))
                last = status
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "event_id", "from_status", "to_status"])

    schema = "key long, event_id long, from_status string, to_status string"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "status string", "append", GroupStateTimeout.NoTimeout)


def fetch_health(stream: DataFrame, trip: int = 3) -> DataFrame:
    """(domain, strategy, failures, open) after every batch: consecutive failures per domain and strategy; at ``trip`` the strategy is
    closed until it succeeds or has been left alone for ten minutes."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*k, 0, True)], columns=["domain", "strategy", "failures", "open"])
            return
        for p in parts:
            for ok in p.sort_values("ts").ok:
                failures = 0 if ok else failures + 1
        state.update((failures,))
        state.setTimeoutDuration(600_000)
        yield pd.DataFrame([(*k, failures, failures < trip)], columns=["domain", "strategy", "failures", "open"])

    schema = "domain string, strategy string, failures int, open boolean"
    grouped = stream.groupBy("domain", "strategy")
    return grouped.applyInPandasWithState(run, schema, "failures int", "update", GroupStateTimeout.ProcessingTimeTimeout)
